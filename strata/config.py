"""Jobs described by a table (JSON or a dict): driver, sources, modules."""

from __future__ import annotations

import importlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from strata.errors import ConfigurationError
from strata.graph import Graph
from strata.names import Selector
from strata.plans.lower import Execution
from strata.sources.drivers import Driver, LayerGenerator, SourceDriver
from strata.sources.storage import ProductStore, StoredSource

_MISSING = object()


class Configuration:
    """A table with typed getters; errors say which parameter they are about."""

    def __init__(self, values: dict):
        self.values = values

    def get(self, key: str, kind: Callable = None, default=_MISSING):
        if key not in self.values:
            if default is not _MISSING:
                return default
            raise ConfigurationError(f"Error retrieving parameter '{key}': missing")
        value = self.values[key]
        try:
            if kind is Selector:
                return Selector.from_config(value)
            if kind is Configuration:
                return Configuration(value)
            if kind in (int, float, str, bool, list, dict) and (not isinstance(value, kind) or kind is int and isinstance(value, bool)) and not (kind is float and isinstance(value, int)):
                raise ConfigurationError(f"not {'an' if kind is int else 'a'} {dict(int='integer', str='string', float='number', bool='boolean', list='list', dict='table')[kind.__name__]}")
            return kind(value) if kind else self.plain(value)
        except ConfigurationError as e:
            raise ConfigurationError(f"Error retrieving parameter '{key}': {e}") from e

    @classmethod
    def plain(cls, value):
        """Lists become tuples (an empty one ``()``), tables stay tables."""
        return tuple(map(cls.plain, value)) if isinstance(value, list) else value

    def selectors(self, key: str) -> list[Selector]:
        return [Selector.from_config(v) for v in self.get(key, list)]

    def __getitem__(self, key: str):
        return self.get(key)

    def __contains__(self, key: str) -> bool:
        return key in self.values


def load(source: str | dict) -> Configuration:
    """From a dict, or a JSON file's path."""
    return Configuration(source if isinstance(source, dict) else json.loads(Path(source).read_text()))


def _module(label: str, spec: dict, search: list[str]):
    if ("cpp" in spec) == ("py" in spec):
        raise ConfigurationError(f"Module '{label}' needs either 'cpp' or 'py', and not both")
    if "cpp" in spec:
        raise ConfigurationError(f"Module '{label}': compiled plugins can't be loaded here; use 'py'")
    for p in reversed(search):
        if p not in sys.path:
            sys.path.insert(0, p)
    return importlib.import_module(spec["py"])


def _driver(spec: dict, sources: list) -> Driver:
    kind = spec.get("plugin") or spec.get("cpp") or spec.get("py")
    if kind == "generate_layers":
        return LayerGenerator.from_config(spec["layers"])
    if kind == "sources":
        return SourceDriver(sources)
    module = importlib.import_module(kind)
    return module.make_driver(Configuration(spec), *sources)


def build(spark: SparkSession, config: Configuration, search: list[str] | None = None) -> Graph:
    """The graph of a job: modules, then sources, then the driver."""
    graph = Graph(spark)
    if "driver" not in config:
        raise ConfigurationError("No driver configured for this graph")
    for label, spec in config.get("modules", dict, {}).items():
        part = Configuration(spec)
        gates = spec.get("experimental_when")
        if spec.get("plugin") == "store":
            store = ProductStore(spark, part.get("output_file", str), part.get("technology", str, "parquet"), spec.get("products"))
            graph.output(label, store.sink, when=gates or ())
            continue
        module = _module(label, spec, search or [])
        # a module's gate holds for all its nodes, or for those it lists as ``gated``
        proxy = graph.proxy(label, {n: gates for n in spec["gated"]} if gates and "gated" in spec else gates)
        module.register_algorithms(proxy, part)
    by_name = {}
    for label, spec in config.get("sources", dict, {}).items():
        part = Configuration(spec)
        if spec.get("plugin") == "store":
            stored = StoredSource(ProductStore(spark, part.get("input_file", str), part.get("technology", str, "parquet")), part.get("creator", str), spec.get("stored_as"))
            by_name[label] = graph.source(label, stored.create_providers, stored.indices)
        else:
            module = _module(label, spec, search or [])
            module.register_providers(graph.proxy(label), part)
    wanted = config["driver"].get("uses_sources", [])
    if missing := [n for n in wanted if n not in by_name]:
        raise ConfigurationError(f"Unknown source with name: {missing[0]}")
    return graph.add_driver(_driver(config["driver"], [by_name[n] for n in wanted]))


def run(spark: SparkSession, source: str | dict, search: list[str] | None = None) -> Execution:
    return build(spark, load(source), search).execute()
