"""Generators for unfolds, as array columns: an element for each child, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def iota(most: Column) -> Column:
    """0 ... most - 1; none if ``most`` is null or not over 0."""
    return F.when(most > 0, F.sequence(F.lit(0).cast("long"), most.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def items(array: Column) -> Column:
    """The elements of an array; none if it is null."""
    return array


def chunks(most: Column, size: int) -> Column:
    """Sizes of the chunks that ``most`` falls into: ``size``, and what is left."""
    starts = F.sequence(F.lit(0).cast("long"), most.cast("long") - 1, F.lit(size).cast("long"))
    return F.when(most > 0, F.transform(starts, lambda s: F.least(F.lit(size).cast("long"), most.cast("long") - s))).otherwise(F.array().cast("array<bigint>"))


def steps(start: Callable, going: Callable, step: Callable, element: str) -> Callable:
    """A general loop in Python: ``v = start(*inputs)``; while ``going(v)``: ``v, made = step(v)``. Runs in Arrow batches."""

    def loop(*inputs: Column) -> Column:
        import pandas as pd

        def run(*columns):
            out = []
            for row in zip(*columns):
                v, made = start(*row), []
                while going(v):
                    v, one = step(v)
                    made.append(one)
                out.append(made)
            return pd.Series(out)

        run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, f"array<{element}>")(*inputs)

    return loop
