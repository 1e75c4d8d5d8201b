"""The graph: operators are registered by name, then executed together."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from strata.errors import ConfigurationError
from strata.names import AlgorithmName, Selector, TypeTag
from strata.operators.nodes import Fold, Node, Observer, Output, Predicate, Provider, Source, Transform, Unfold
from strata.plans.lower import Execution
from strata.sources.drivers import Driver, JobDriver


def _inputs(inputs: Iterable[Selector | dict]) -> tuple[Selector, ...]:
    return tuple(s if isinstance(s, Selector) else Selector.from_config(s) for s in inputs)


class Graph:
    """Registers nodes and executes them.

    Errors of registration are collected and raised by ``execute``; an empty name
    is refused at once. ``plugin`` becomes the first half of the names of nodes
    registered through it, ``when`` (by node name, or one list for all of them)
    overrides their gates.
    """

    def __init__(self, spark: SparkSession, driver: Driver | None = None):
        self.spark = spark
        self.driver = driver
        self.nodes: dict[str, Node] = {}
        self.sources: dict[str, Source] = {}
        self.errors: list[str] = []
        self._ran = False

    @classmethod
    def with_default_driver(cls, spark: SparkSession) -> Graph:
        """Only the job cell."""
        return cls(spark, JobDriver())

    def add_driver(self, driver: Driver | None) -> Graph:
        if self.driver is not None:
            raise ConfigurationError("Driver has already been configured for this graph")
        if driver is None:
            raise ConfigurationError("Cannot configure a graph with an empty driver.")
        self.driver = driver
        return self

    def proxy(self, plugin: str, when: dict[str, list[str]] | list[str] | None = None) -> Module:
        return Module(self, plugin, when or {})

    def _add(self, node: Node) -> Node:
        if node.key in self.nodes:
            self.errors.append(f"Node with name '{node.key}' already exists")
        else:
            self.nodes[node.key] = node
        return node

    @staticmethod
    def _name(name: str) -> AlgorithmName:
        if not name:
            raise ConfigurationError("Cannot register a node with an empty name.")
        return AlgorithmName.parse(name)

    def source(self, name: str, create_providers: Callable, indices: Callable | None = None) -> Source:
        if not name:
            raise ConfigurationError("Cannot register a source with an empty name.")
        made = Source(name, create_providers, indices)
        if name in self.sources:
            self.errors.append(f"Source with name '{name}' already exists")
        else:
            self.sources[name] = made
        return made

    def provide(self, name: str, fn: Callable, *, creator: str, layer: str, suffix: str = "", stage: str = "CURRENT", type: TypeTag | None = None, concurrency: int | str = "serial") -> Node:
        return self._add(Provider(self._name(name), (), (), concurrency, (suffix,), (type,), fn, layer, creator, stage))

    def transform(self, name: str, fn: Callable, *, inputs, outputs=("",), types=(None,), when=(), concurrency: int | str = "serial") -> Node:
        return self._add(Transform(self._name(name), _inputs(inputs), tuple(when), concurrency, tuple(outputs), tuple(types), fn))

    def predicate(self, name: str, fn: Callable, *, inputs, when=(), concurrency: int | str = "serial") -> Node:
        return self._add(Predicate(self._name(name), _inputs(inputs), tuple(when), concurrency, fn))

    def observe(self, name: str, fn: Callable | None = None, *, inputs, check: Callable | None = None, when=(), concurrency: int | str = "serial") -> Node:
        return self._add(Observer(self._name(name), _inputs(inputs), tuple(when), concurrency, fn, check))

    def fold(self, name: str, fn: Callable | None, *, inputs, partition: str = "job", initial=0, combine=None, finish=None, python=None, type: str = "double", outputs=("",), types=(None,), when=(), concurrency: int | str = "serial") -> Node:
        if len(outputs) != 1:
            self.errors.append(f"Fold '{name}' must have one output, not {len(outputs)}")
        return self._add(Fold(self._name(name), _inputs(inputs), tuple(when), concurrency, tuple(outputs), tuple(types), fn, partition, initial, combine, finish, python, type))

    def unfold(self, name: str, fn: Callable, *, inputs, layer: str, outputs=("",), types=(None,), when=(), concurrency: int | str = "serial") -> Node:
        if not layer or layer == "job":
            self.errors.append(f"Unfold '{name}' needs a layer of its own")
        return self._add(Unfold(self._name(name), _inputs(inputs), tuple(when), concurrency, tuple(outputs), tuple(types), fn, layer))

    def output(self, name: str, fn: Callable, *, when=()) -> Node:
        return self._add(Output(self._name(name), (), tuple(when), "serial", fn))

    def execute_provider(self, name: str):
        """Executes and returns a provider's own product: providers that nothing consumes are otherwise never run."""
        run = self.execute()
        run.require(name)
        return run.result(name)

    def execute(self) -> Execution:
        """Plans everything, runs the observers and outputs, and returns what was made."""
        if self.errors:
            raise ConfigurationError("Configuration errors:\n" + "\n".join(f"  - {e}" for e in self.errors))
        if self.driver is None:
            raise ConfigurationError("No driver configured for this graph")
        if self._ran:
            raise ConfigurationError("This graph has been executed already")
        self._ran = True
        run = Execution(self.spark, self.driver, self.nodes, self.sources)
        run.run_sinks()
        return run


class Module:
    """Registers nodes under a plugin's name."""

    def __init__(self, graph: Graph, plugin: str, when: dict[str, list[str]] | list[str]):
        self._graph, self._plugin, self._when = graph, plugin, when

    def __getattr__(self, kind: str):
        if kind not in ("provide", "transform", "predicate", "observe", "fold", "unfold", "output"):
            raise AttributeError(kind)
        register = getattr(self._graph, kind)

        def call(name: str, *args, **more):
            if kind != "provide" and (gates := self._gates(name)) is not None:
                more["when"] = tuple(gates)
            return register(f"{self._plugin}:{name}" if name and self._plugin else name, *args, **more)

        return call

    def _gates(self, name: str) -> list[str] | None:
        if isinstance(self._when, dict):
            return self._when.get(name)
        # a predicate can't wait for itself
        return None if {name, f"{self._plugin}:{name}"} & set(self._when) else self._when

    def source(self, name: str, *args, **more) -> Source:
        return self._graph.source(name, *args, **more)
