"""Drivers say which cells there are: a DataFrame of key columns for each layer path."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strata.errors import ConfigurationError
from strata.names import LayerPath, cell_text

#: A column that the job's only row has, as a DataFrame needs one.
JOB_CELL = "_job"


class Driver:
    """``frames`` gives one DataFrame a layer path, the job excepted, with the path's key columns (and more, if it has them)."""

    def frames(self, spark: SparkSession) -> dict[LayerPath, DataFrame]:
        return {}

    def counts(self, spark: SparkSession) -> dict[LayerPath, int] | None:
        """Cells of each path where they are known without a scan."""
        return None


def job_frame(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(True).alias(JOB_CELL))


class JobDriver(Driver):
    """Only the job cell."""

    def counts(self, spark):
        return {LayerPath("job"): 1}


class FixedHierarchy:
    """A declared set of layer paths; empty means that anything goes."""

    def __init__(self, paths: Iterable = ()):
        self.paths = sorted({p if isinstance(p, LayerPath) else LayerPath(p) for p in paths})

    def update(self, other: FixedHierarchy) -> FixedHierarchy:
        return FixedHierarchy([*self.paths, *other.paths])

    def validate(self, path: LayerPath) -> None:
        if self.paths and path != LayerPath("job") and path not in self.paths:
            raise ConfigurationError(f"Layer {path} is not part of the fixed hierarchy")


class LayerGenerator(Driver):
    """A regular synthetic tree: each layer has ``count`` cells below every parent cell, numbered from ``start_at``.

    Keys come from the row number by division, so that a layer of any size is
    made in parallel and without a shuffle.
    """

    def __init__(self):
        self._layers: dict[tuple[str, ...], tuple[int, int]] = {}
        self._waiting: dict[tuple[str, ...], tuple[int, int]] = {}

    def add_layer(self, name: str, parent: str = "job", count: int = 1, start_at: int = 0) -> LayerGenerator:
        if count < 0:
            raise ConfigurationError(f"Layer '{name}' cannot have a negative number of cells")
        # a name, or the end of a path (from the job on if it begins with a slash)
        tail = tuple(parent.strip("/").split("/"))
        whole = parent.startswith("/")
        parents = [("job",)] if tail == ("job",) else [p for p in (*self._layers, *self._waiting) if (p == tail if whole else p[-len(tail) :] == tail)]
        if len(parents) > 1:
            a, b = ("/" + "/".join(p) for p in sorted(parents)[:2])
            raise ConfigurationError(f"Ambiguous: two parent layers found for data layer '{name}': {a} and {b}; name the parent's whole path")
        known = not parents or parents[0][0] == "job"
        path = (*(parents[0] if parents else tail), name)
        (self._layers if parents and known else self._waiting)[path] = count, start_at
        for p in list(self._waiting):  # what waited for this parent, by the end of its path
            n = next((n for n in range(len(p) - 1, 0, -1) if path[-n:] == p[:n]), 0)
            if n and p != path:
                (self._layers if path[0] == "job" else self._waiting)[(*path, *p[n:])] = self._waiting.pop(p)
        return self

    @classmethod
    def from_config(cls, layers: dict[str, dict]) -> LayerGenerator:
        """``{name: {parent = 'job', total, starting_number = 0}}``."""
        made = cls()
        for name, spec in layers.items():
            made.add_layer(name, spec.get("parent", "job"), int(spec["total"]), int(spec.get("starting_number", 0)))
        return made

    def _check(self) -> None:
        if self._waiting:
            missing = sorted({"/".join(p[:-1]) for p in self._waiting})
            raise ConfigurationError(f"No parent layer found with the name {missing[0]!r}")

    def counts(self, spark=None) -> dict[LayerPath, int]:
        self._check()
        out = {LayerPath("job"): 1}
        for p in sorted(self._layers, key=len):
            out[LayerPath(p)] = out[LayerPath(p[:-1])] * self._layers[p][0]
        return out

    def emitted_cell_count(self, path: str = "") -> int:
        counts = self.counts()
        if not path:
            return sum(counts.values())
        found = LayerPath(path)
        if found not in counts:
            raise ConfigurationError(f"No emitted cells corresponding to layer path '{path}'")
        return counts[found]

    def frames(self, spark: SparkSession) -> dict[LayerPath, DataFrame]:
        out = {}
        counts = self.counts()
        for p in self._layers:
            path, below = LayerPath(p), 1
            keys = []
            for k in range(len(p), 1, -1):
                count, start = self._layers[p[:k]]
                keys.append((F.lit(start) + F.floor(F.col("id") / below) % max(count, 1)).cast("long").alias(path.keys[k - 2]))
                below *= max(count, 1)
            out[path] = spark.range(counts[path]).select(*reversed(keys))
        return out


class TableDriver(Driver):
    """Layers that are tables: each path's DataFrame, with the columns that hold its keys from the top layer down.

    Each frame's key tuple must be unique; ``number_rows`` makes it so for rows
    without a number of their own.
    """

    def __init__(self):
        self._frames: dict[LayerPath, DataFrame] = {}

    def add(self, path: str, frame: DataFrame, keys: Iterable[str]) -> TableDriver:
        p, keys = LayerPath(path), list(keys)
        if len(keys) != p.depth:
            raise ConfigurationError(f"Layer {p} needs {p.depth} key columns, not {len(keys)}")
        self._frames[p] = frame.select(*(F.col(c).cast("long").alias(k) for c, k in zip(keys, p.keys)), *(c for c in frame.columns if c not in p.keys))
        return self

    def frames(self, spark: SparkSession) -> dict[LayerPath, DataFrame]:
        out = dict(self._frames)
        for p in list(out):
            up = p.parent
            while up is not None and up.depth and up not in out:  # a parent without a table of its own: what its children name
                out[up] = out[p].select(*up.keys).distinct()
                up = up.parent
        return out


def number_rows(frame: DataFrame, by: Iterable[str], name: str) -> DataFrame:
    """Numbers rows from 0 within each ``by`` group, in the order of all columns: equal rows get numbers in any order."""
    from pyspark.sql import Window

    by = list(by)
    order = [c for c in frame.columns if c not in by] or by
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


class Cell:
    """One cell while a driver function walks the tree."""

    def __init__(self, sink: _Sink, path: LayerPath, numbers: tuple[int, ...]):
        self._sink, self.path, self.numbers = sink, path, numbers

    @property
    def number(self) -> int:
        return self.numbers[-1] if self.numbers else -1

    def yield_child(self, layer: str, number: int) -> Cell:
        return self._sink.put(Cell(self._sink, self.path.child(layer), (*self.numbers, number)))

    child = yield_child

    def parent(self, layer: str) -> Cell | None:
        """The nearest ancestor (never itself) of that layer."""
        for k in range(len(self.path) - 2, -1, -1):
            if self.path[k] == layer:
                return Cell(self._sink, LayerPath(self.path[: k + 1]), self.numbers[:k])
        return None

    def __str__(self) -> str:
        return cell_text(list(self.path[1:]), list(self.numbers))


class _Sink:
    def __init__(self, hierarchy: FixedHierarchy):
        self.hierarchy, self.rows = hierarchy, {}

    def put(self, cell: Cell) -> Cell:
        self.hierarchy.validate(cell.path)
        self.rows.setdefault(cell.path, []).append(cell.numbers)
        return cell


class CellDriver(Driver):
    """A user's function that names cells one by one, in the driver program: for trees small enough to be listed.

    The function gets the job's cell (and the sources given) and calls
    ``yield_child``; or it is a generator and yields the children it makes, the
    job's cell included. A builder object with ``hierarchy()`` and
    ``driver_function()`` may stand for both arguments.
    """

    def __init__(self, fn: Callable | object | None, hierarchy: FixedHierarchy | None = None, sources: Iterable = ()):
        if fn is None:
            raise ConfigurationError("Cannot configure driver with an empty driver builder")
        if hasattr(fn, "driver_function"):
            fn, hierarchy = fn.driver_function(), fn.hierarchy()
        self.fn, self.hierarchy, self.sources = fn, hierarchy or FixedHierarchy(), list(sources)

    def _walk(self) -> dict[LayerPath, list[tuple[int, ...]]]:
        sink = _Sink(self.hierarchy)
        made = self.fn(Cell(sink, LayerPath("job"), ()), *self.sources)
        for cell in made or ():
            if not isinstance(cell, Cell):
                raise ConfigurationError("A driver must yield cells")
        return sink.rows

    def frames(self, spark: SparkSession) -> dict[LayerPath, DataFrame]:
        out = {}
        for path, rows in self._walk().items():
            schema = StructType([StructField(k, LongType(), False) for k in path.keys])
            out[path] = spark.createDataFrame(list(dict.fromkeys(rows)), schema)
        return out


class SourceDriver(Driver):
    """The cells that sources list: each source's ``indices(spark)`` gives path and frame pairs."""

    def __init__(self, sources: Iterable):
        self.sources = list(sources)
        seen = Counter(s.name for s in self.sources)
        if twice := [n for n, k in seen.items() if k > 1]:
            raise ConfigurationError(f"Source '{twice[0]}' is given twice to the driver")

    def frames(self, spark: SparkSession) -> dict[LayerPath, DataFrame]:
        out: dict[LayerPath, DataFrame] = {}
        for s in self.sources:
            if s.indices is None:
                raise ConfigurationError(f"Source '{s.name}' lists no cells")
            for path, frame in s.indices(spark):
                out[path] = frame if path not in out else out[path].unionByName(frame).distinct()
        return out
