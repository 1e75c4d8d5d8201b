"""Lowers a graph to DataFrames: one wide frame for each layer path.

A frame has the path's key columns and a column for each product made there.
Products of one layer are columns of one frame, so nodes on the same layer never
join; a parent's product is joined in on the parent's keys once, and carried
along when a frame is unfolded. A gated node marks where it ran in a boolean
column, and only its own consumers see the gate.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import ConfigurationError, StrataError
from strata.names import LayerPath, cell_text
from strata.operators.nodes import Fold, Node, Observer, Output, Predicate, Producer, Provider, Source, Transform, Unfold
from strata.plans.resolve import ProductRef, Resolver
from strata.sources.drivers import JOB_CELL, Driver, job_frame


@dataclass
class Frame:
    """A layer path's DataFrame, and which column holds what."""

    path: LayerPath
    df: DataFrame
    #: Products made on this layer, and those repeated from ancestors.
    own: dict[ProductRef, str] = field(default_factory=dict)
    repeated: dict[ProductRef, str] = field(default_factory=dict)
    #: Decisions of predicates, own and repeated.
    decisions: dict[str, str] = field(default_factory=dict)
    #: Column that says whether the node ran on a cell; nodes without one ran on all.
    ran: dict[str, str] = field(default_factory=dict)
    #: Nodes whose results live here.
    nodes: set[str] = field(default_factory=set)

    @property
    def keys(self) -> list[str]:
        return list(self.path.keys)


class CellColumns:
    """What a provider's function sees of a cell: key columns by layer, and the columns of the driver's frame."""

    def __init__(self, frame: Frame):
        self._frame = frame

    @property
    def number(self) -> Column:
        return F.col(self._frame.keys[-1]) if self._frame.keys else F.lit(-1).cast("long")

    def key(self, layer: str) -> Column:
        at = [k for n, k in zip(self._frame.path[1:], self._frame.keys) if n == layer]
        if not at:
            raise ConfigurationError(f"Layer {self._frame.path} has no ancestor '{layer}'")
        return F.col(at[-1])

    def column(self, name: str) -> Column:
        return F.col(name)

    @property
    def index(self) -> Column:
        """All keys as one structure."""
        return F.struct(*self._frame.keys) if self._frame.keys else F.struct(F.lit(-1).cast("long").alias("job"))

    @property
    def text(self) -> Column:
        """``[run:0, event:5]``."""
        parts = [F.concat(F.lit(f"{n}:"), F.col(k).cast("string")) for n, k in zip(self._frame.path[1:], self._frame.keys)]
        return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")) if parts else F.lit("[]")


def _column(key: str, suffix: str) -> str:
    return re.sub(r"\W", "_", key) + "__" + re.sub(r"\W", "_", suffix)


class Execution:
    """A planned graph: frames by layer path, results by node. Nothing is computed until a result is used."""

    def __init__(self, spark: SparkSession, driver: Driver, nodes: dict[str, Node], sources: dict[str, Source]):
        self.spark, self.nodes, self.driver = spark, nodes, driver
        self.frames: dict[LayerPath, Frame] = {LayerPath("job"): Frame(LayerPath("job"), job_frame(spark))}
        for path, df in sorted(driver.frames(spark).items(), key=lambda x: len(x[0])):
            self.frames[path] = Frame(path, df)
        self.resolver = Resolver(nodes, sources)
        self._check_gates()
        self._refs = self.resolver.resolve_all([n for n in nodes.values() if n.inputs])
        self._check_unfolds()
        self._state: dict[str, str] = {}
        self._folded: dict[str, Callable[[], int]] = {}
        # what unfolds find on their parents travels with the children; a join brings only what is made later
        unfolded = {n.layer for n in nodes.values() if isinstance(n, Unfold)}
        for ref in dict.fromkeys(r for refs in self._refs.values() for r in refs):
            n = self.resolver.node(ref.node)
            if isinstance(n, Provider) and n.layer not in unfolded:
                self._lower(ref.node)
        # layers come into being with unfolds: what adds cells is lowered before what looks for them
        for n in nodes.values():
            if isinstance(n, Unfold):
                self._lower(n.key)
        for n in nodes.values():
            if not isinstance(n, Provider):
                self._lower(n.key)

    # --- checks ---

    def _check_gates(self) -> None:
        for n in self.nodes.values():
            for p in n.when:
                if not isinstance(self.nodes.get(p), Predicate) and not self._predicate(p):
                    raise ConfigurationError(f"A non-existent filter with the name '{p}' was specified for {n.key}")

    def _predicate(self, name: str) -> Predicate | None:
        found = [n for n in self.nodes.values() if isinstance(n, Predicate) and (n.key == name or n.name.algorithm == name)]
        return found[0] if len(found) == 1 else None

    def _check_unfolds(self) -> None:
        made = {n.layer: n for n in self.nodes.values() if isinstance(n, Unfold)}

        def above(layer: str, seen: tuple[str, ...]) -> None:
            if layer in seen:
                raise ConfigurationError(f"Unfolds make a cycle of layers: {' -> '.join((*seen, layer))}")
            if layer in made:
                for s in made[layer].inputs:
                    above(s.layer, (*seen, layer))

        for layer in made:
            above(layer, ())

    # --- lowering ---

    def _lower(self, key: str) -> None:
        state = self._state.get(key)
        if state == "done":
            return
        if state == "open":
            raise ConfigurationError(f"Node '{key}' depends on itself")
        self._state[key] = "open"
        node = self.resolver.node(key)
        for ref in self._refs.get(key, ()):
            self._lower(ref.node)
        for p in node.when:
            self._lower(self._predicate(p).key)
        {Provider: self._provide, Transform: self._transform, Predicate: self._predicate_on, Fold: self._fold, Unfold: self._unfold}.get(type(node), lambda k, n: None)(key, node)
        self._state[key] = "done"

    def _provide(self, key: str, node: Provider) -> None:
        at = [f for f in self.frames.values() if f.path.name == node.layer]
        if not at:
            raise ConfigurationError(f"No layer named '{node.layer}' for provider '{key}'")
        for f in at:
            self._put(f, key, node, [node.fn(CellColumns(f))], None)

    def _put(self, f: Frame, key: str, node: Producer, values: list[Column], ran: Column | None) -> None:
        """Adds a node's products, null where it didn't run."""
        if len(values) != len(node.suffixes):
            raise ConfigurationError(f"Node '{key}' has {len(node.suffixes)} output suffixes but {len(values)} outputs")
        cols: dict[str, Column] = {}
        if ran is not None:
            mark = _column(key, "ran")
            f.df = f.df.withColumn(mark, ran)
            f.ran[key] = mark
        for k, v in enumerate(values):
            name = _column(key, node.suffixes[k]) + (f"_{k}" if node.suffixes.count(node.suffixes[k]) > 1 else "")
            cols[name] = v if ran is None else F.when(F.col(f.ran[key]), v)
            f.own[ProductRef(key, k)] = name
        f.df = f.df.withColumns(cols)
        f.nodes.add(key)

    def _holder(self, f: Frame, holds: Callable[[Frame], bool]) -> Frame | None:
        """The nearest of the frame and its ancestors that holds something."""
        path: LayerPath | None = f.path
        while path is not None:
            g = self.frames.get(path)
            if g is not None and holds(g):
                return g
            path = path.parent
        return None

    def _meeting(self, node: Node, key: str) -> list[Frame]:
        """Frames where all inputs meet: one input's own layer, the others on it or above."""
        refs = self._refs.get(key, [])
        out = []
        for f in self.frames.values():
            holders = [self._holder(f, lambda g, r=r, s=s: r in g.own and g.path.name == s.layer) for r, s in zip(refs, node.inputs)]
            if all(holders) and any(h is f for h in holders):
                out.append(f)
        if not out:
            layers = ", ".join(s.layer for s in node.inputs)
            raise ConfigurationError(f"The inputs of '{key}' ({layers}) never meet on one cell")
        return out

    def _bring(self, f: Frame, g: Frame, columns: list[tuple[str, str | None]]) -> None:
        """Joins columns of an ancestor's frame into ``f``: (name, presence mark) pairs, new ones only."""
        need = [c for pair in columns for c in pair if c and c not in f.df.columns]
        if not need:
            return
        if not g.keys:
            f.df = f.df.crossJoin(F.broadcast(g.df.select(*need)))  # the job's frame has one row
            return
        # Spark broadcasts the parent where its size allows, and else shuffles both sides on the keys
        f.df = f.df.join(g.df.select(*g.keys, *need), g.keys, "left")

    def _arguments(self, f: Frame, node: Node, key: str) -> tuple[list[Column], Column | None]:
        """The inputs' columns on a frame, and the condition under which the node runs there (None: always)."""
        args, runs = [], []
        for ref, s in zip(self._refs.get(key, ()), node.inputs):
            g = self._holder(f, lambda h, ref=ref, s=s: ref in h.own and h.path.name == s.layer)
            column, mark = g.own[ref], g.ran.get(ref.node)
            if g is not f:
                has = f"_has_{'_'.join(g.path)}"
                if mark is None and (column not in f.df.columns or has in f.df.columns):  # joined in: a parent cell may be missing altogether
                    mark = has
                    if mark not in g.df.columns:
                        g.df = g.df.withColumn(mark, F.lit(True))
                self._bring(f, g, [(column, mark)])
                f.repeated[ref] = column
            args.append(F.struct(*g.keys, F.col(column).alias("value")) if s.handle else F.col(column))
            if mark:
                runs.append(F.coalesce(F.col(mark), F.lit(False)))
        for p in node.when:
            pred = self._predicate(p)
            g = self._holder(f, lambda h, pred=pred: pred.key in h.decisions)
            if g is None:
                raise ConfigurationError(f"Predicate '{p}' makes no decision on layer {f.path} or above it, where '{key}' runs")
            column = g.decisions[pred.key]
            if g is not f:
                self._bring(f, g, [(column, None)])
            runs.append(F.coalesce(F.col(column), F.lit(False)))
        return args, reduce(lambda a, b: a & b, runs) if runs else None

    @staticmethod
    def _listed(made) -> list[Column]:
        return list(made) if isinstance(made, (tuple, list)) else [made]

    def _transform(self, key: str, node: Transform) -> None:
        for f in self._meeting(node, key):
            args, ran = self._arguments(f, node, key)
            self._put(f, key, node, self._listed(node.fn(*args)), ran)

    def _predicate_on(self, key: str, node: Predicate) -> None:
        for f in self._meeting(node, key):
            args, ran = self._arguments(f, node, key)
            made = node.fn(*args).cast("boolean")
            name = _column(key, "decision")
            f.df = f.df.withColumn(name, made if ran is None else F.when(ran, made))
            f.decisions[key] = name
            f.nodes.add(key)

    def _fold(self, key: str, node: Fold) -> None:
        partitions = [f for f in self.frames.values() if f.path.name == node.partition]
        if not partitions:
            raise ConfigurationError(f"No layer named '{node.partition}' for the partition of fold '{key}'")
        meeting = self._meeting(node, key)
        counts: list[DataFrame] = []
        for p in partitions:
            parts = []
            for f in meeting:
                if not f.path.is_under(p.path):
                    continue
                args, ran = self._arguments(f, node, key)
                rows = f.df if ran is None else f.df.where(ran)
                parts.append(rows.select(*f.keys[: p.path.depth], *(a.alias(f"_a{k}") for k, a in enumerate(args))))
            self._put_fold(p, key, node, reduce(DataFrame.unionByName, parts) if parts else None)
            counts += parts
        self._folded[key] = lambda: sum(c.count() for c in counts)

    def _put_fold(self, p: Frame, key: str, node: Fold, rows: DataFrame | None) -> None:
        args = [F.col(f"_a{k}") for k in range(len(node.inputs))]
        many = isinstance(node.initial, dict)
        if rows is None:
            value = F.struct(*(F.lit(v).alias(k) for k, v in node.initial.items())) if many else F.lit(node.initial)
            self._put(p, key, node, [node.finish(value) if node.finish else value], None)
            return
        if node.python:
            folded, parts = self._python_fold(rows, p.keys, node), {"_v": F.col("_v")}
        else:
            made = node.fn(*args)
            parts = made if isinstance(made, dict) else {"_v": made}
            grouped = rows.groupBy(*p.keys) if p.keys else rows
            folded = grouped.agg(*(v.alias(f"_r_{k}") for k, v in parts.items()), F.count(F.lit(1)).alias("_n"))
        folded = folded.withColumnRenamed("_v", "_r__v")
        p.df = p.df.join(folded, p.keys, "left") if p.keys else p.df.crossJoin(F.broadcast(folded))  # one row by one row
        if node.python:
            value = F.col("_r__v") if node.initial is None else F.coalesce(F.col("_r__v"), F.lit(node.initial))
        else:
            value = {k: self._combined(node, F.lit(node.initial[k]) if many else self._initial(node), F.col(f"_r_{k}")) for k in parts}
            value = F.struct(*(v.alias(k) for k, v in value.items())) if many else value["_v"]
        self._put(p, key, node, [node.finish(value) if node.finish else value], None)
        p.df = p.df.drop("_n", *(f"_r_{k}" for k in parts))

    @staticmethod
    def _initial(node: Fold):
        return None if node.initial is None else F.array(*map(F.lit, node.initial)) if isinstance(node.initial, (list, tuple)) else F.lit(node.initial)

    @staticmethod
    def _combined(node: Fold, initial: Column | None, made: Column) -> Column:
        if node.combine:
            return node.combine(initial, made)
        if initial is None:
            return made
        if isinstance(node.initial, (list, tuple)):
            return F.when(made.isNull(), initial).otherwise(made)
        if isinstance(node.initial, dict) or isinstance(node.initial, (int, float)) and not isinstance(node.initial, bool):
            return F.when(made.isNull(), initial).otherwise(initial + made)
        return F.coalesce(made, initial)

    def _python_fold(self, rows: DataFrame, keys: list[str], node: Fold) -> DataFrame:
        """Partial accumulators for each task first, so that a partition's cells never meet in one group; then few states a partition."""
        zero, step, merge, finish = node.python
        n, k = len(node.inputs), len(keys)
        kinds = dict(rows.dtypes)

        def partial(frames):
            import pandas as pd

            held: dict[tuple, object] = {}

            def out():
                table = pd.DataFrame([(*g, pickle.dumps(s)) for g, s in held.items()], columns=[*keys, "_s"])
                held.clear()
                return table

            for frame in frames:
                columns = [frame[c].tolist() for c in (*keys, *(f"_a{i}" for i in range(n)))]
                for row in zip(*columns):
                    g = row[:k]
                    held[g] = step(held[g] if g in held else zero(), *row[k:])
                if len(held) > 50_000:
                    yield out()
            if held:
                yield out()

        def total(frame):
            import pandas as pd

            state = reduce(merge, map(pickle.loads, frame["_s"]))
            return pd.DataFrame([[*(frame[c].iloc[0] for c in keys), finish(state)]], columns=[*keys, "_v"])

        schema = ", ".join(f"{c} {kinds[c]}" for c in keys)
        states = rows.mapInPandas(partial, (schema + ", " if keys else "") + "_s binary")
        return states.groupBy(*keys).applyInPandas(total, (schema + ", " if keys else "") + f"_v {node.type}")

    def _unfold(self, key: str, node: Unfold) -> None:
        for f in self._meeting(node, key):
            path = f.path.child(node.layer)
            if path in self.frames:
                raise ConfigurationError(f"Layer {path}, made by '{key}', exists already")
            args, ran = self._arguments(f, node, key)
            rows = f.df if ran is None else f.df.where(ran)
            name = path.keys[-1]
            one = _column(key, "child")
            df = rows.select("*", F.posexplode(node.fn(*args)).alias(name, one)).withColumn(name, F.col(name).cast("long"))
            child = Frame(path, df, {}, {**f.repeated, **f.own}, dict(f.decisions))
            multi = len(node.suffixes) > 1
            cols = {}
            for k, s in enumerate(node.suffixes):
                column = _column(key, s) + (f"_{k}" if node.suffixes.count(s) > 1 else "")
                cols[column] = F.col(one)[df.schema[one].dataType.fields[k].name] if multi else F.col(one)
                child.own[ProductRef(key, k)] = column
            child.df = df.withColumns(cols).drop(one)
            child.nodes.add(key)
            self.frames[path] = child

    # --- results ---

    def require(self, key: str) -> None:
        """Lowers a provider that no node consumes."""
        self._lower(next((k for k in self.nodes if k == key or self.nodes[k].name.algorithm == key), key))

    def _frames_of(self, key: str) -> list[Frame]:
        if key not in self.nodes and key not in self.resolver.implicit:
            found = [n for n in self.nodes if self.nodes[n].name.algorithm == key]
            if len(found) != 1:
                raise StrataError(f"No node with name '{key}'")
            key = found[0]
        return [f for f in self.frames.values() if key in f.nodes]

    def node_frames(self, key: str) -> dict[LayerPath, DataFrame]:
        """A node's results by layer path: keys and a column for each output suffix (``value`` for an empty one); for a predicate, ``decision``."""
        out = {}
        for f in self._frames_of(key):
            own = next(k for k in f.nodes if k == key or self.resolver.node(k).name.algorithm == key)
            node = self.resolver.node(own)
            if isinstance(node, Predicate):
                out[f.path] = f.df.where(F.col(f.decisions[own]).isNotNull()).select(*f.keys, F.col(f.decisions[own]).alias("decision"))
                continue
            rows = f.df.where(F.coalesce(F.col(f.ran[own]), F.lit(False))) if own in f.ran else f.df
            names = [s or "value" for s in node.suffixes]
            names = [s if names.count(s) == 1 else f"{s}_{k}" for k, s in enumerate(names)]
            out[f.path] = rows.select(*f.keys, *(F.col(f.own[ProductRef(own, k)]).alias(s) for k, s in enumerate(names)))
        return out

    def result(self, key: str, path: str | None = None) -> DataFrame:
        """A node's result, on the only path it has or the one given."""
        found = self.node_frames(key)
        if path is not None:
            found = {p: d for p, d in found.items() if p.ends_with(path)}
        if len(found) != 1:
            raise StrataError(f"Node '{key}' has results on {len(found)} layer paths" + (f" that end with '{path}'" if path else ""))
        return next(iter(found.values()))

    def execution_count(self, key: str) -> int:
        """Cells on which a node ran; for a fold, cells folded."""
        full = next((k for k in self.nodes if k == key or self.nodes[k].name.algorithm == key), None)
        if full is None:
            raise StrataError(f"No node with name '{key}'")
        if full in self._folded:
            return self._folded[full]()
        if isinstance(self.nodes[full], Observer):
            return sum(self._observed(self.nodes[full]))
        if isinstance(self.nodes[full], Unfold):
            total = 0
            for f in self._meeting(self.nodes[full], full):
                _, ran = self._arguments(f, self.nodes[full], full)
                total += (f.df if ran is None else f.df.where(ran)).count()
            return total
        return sum(d.count() for d in self.node_frames(full).values())

    def _path(self, layer: str) -> LayerPath | None:
        found = [p for p in self.frames if p.ends_with(layer)]
        if len(found) > 1:
            raise StrataError(f"Ambiguous: several layer paths end with '{layer}': {', '.join(map(str, sorted(found)))}")
        return found[0] if found else None

    def seen_cell_count(self, layer: str, missing_ok: bool = False) -> int:
        path = self._path(layer)
        if path is None:
            if missing_ok:
                return 0
            raise StrataError(f"No layers found that end with '{layer}'")
        return self.frames[path].df.count()

    def cells(self, layer: str) -> DataFrame:
        """A layer's key columns."""
        path = self._path(layer)
        if path is None:
            raise StrataError(f"No layers found that end with '{layer}'")
        f = self.frames[path]
        return f.df.select(*(f.keys or [JOB_CELL]))

    def hierarchy(self) -> str:
        """The tree of layers with their numbers of cells, as text."""
        lines = []
        for p in sorted(self.frames):
            lines.append("  " * p.depth + f"{p.name}: {self.frames[p].df.count()}")
        return "\n".join(lines)

    # --- sinks ---

    def _observed(self, node: Observer) -> list[int]:
        return [self._rows(f, node)[0].count() for f in self._meeting(node, node.key)]

    def _rows(self, f: Frame, node: Observer) -> tuple[DataFrame, list[str]]:
        args, ran = self._arguments(f, node, node.key)
        names = [f"arg{k}" for k in range(len(args))]
        rows = f.df if ran is None else f.df.where(ran)
        return rows.select(*f.keys, *(a.alias(n) for a, n in zip(args, names))), names

    def run_sinks(self) -> None:
        """Runs observers, then outputs."""
        for node in self.nodes.values():
            if isinstance(node, Observer):
                for f in self._meeting(node, node.key):
                    rows, names = self._rows(f, node)
                    if node.check is not None:
                        bad = rows.where(~F.coalesce(node.check(*map(F.col, names)), F.lit(False)))
                        if first := bad.limit(1).collect():
                            where = cell_text(list(f.path[1:]), [first[0][k] for k in f.keys])
                            raise StrataError(f"Observer '{node.key}' failed on cell {where}")
                    if node.fn is not None:
                        fn = node.fn
                        rows.foreachPartition(lambda part, fn=fn, names=names: _observe(part, fn, names))
        for node in self.nodes.values():
            if isinstance(node, Output):
                for key in [*self.nodes, *self.resolver.implicit]:
                    if isinstance(self.resolver.node(key), Producer) and self._frames_of(key):
                        for f in self._frames_of(key):
                            self._write(node, key, f)

    def _write(self, node: Output, key: str, f: Frame) -> None:
        df = self.node_frames(key)[f.path]
        if node.when:
            keep = df.columns
            _, ran = self._arguments(f, node, node.key)
            mark = f.df.where(ran).select(*f.keys) if f.keys else f.df.where(ran).select(JOB_CELL)
            df = df.join(mark, f.keys, "left_semi") if f.keys else df.crossJoin(F.broadcast(mark))
            df = df.select(*keep)
        node.fn(key, f.path, df)


def _observe(rows, fn, names) -> None:
    for r in rows:
        fn(*(r[n] for n in names))
