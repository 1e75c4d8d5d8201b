"""A streaming fold that ends by announcement, not by time.

The stream carries data rows and announcements. An announcement says how many
cells a partition has below it; the partition's result is emitted once so many
have been seen, in whatever order rows and announcements come. A partition that several
sources announce (layers below it, or parts of the stream) waits for as many
announcements as it is told of; they add up. State is three numbers a partition
that is still open and a flag for a closed one: what comes later than its result
is an error, and never a second result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, announcements: int = 1) -> Iterator[pd.DataFrame]:
    total, seen, expected, said_so_far = state.get if state.exists else (0.0, 0, 0, 0)
    closed = said_so_far < 0
    for f in frames:
        data = f[f["announced"].isna()]
        total += float(data["value"].sum())
        seen += len(data)
        said = f["announced"].dropna()
        if closed and (len(data) or said.sum()):
            raise ValueError(f"partition {key} is closed, and more came for it")
        expected += int(said.sum())
        said_so_far += len(said)
    if closed:
        return
    if said_so_far >= announcements and seen >= expected:
        state.update((0.0, 0, 0, -1))
        yield pd.DataFrame([[*key, total, seen]])
    else:
        state.update((total, seen, expected, said_so_far))


def announced_fold(rows: DataFrame, keys: list[str], value: str = "value", announced: str = "announced", initial: float = 0.0, announcements: int = 1) -> DataFrame:
    """Sum and count of ``value`` for each key tuple of a stream.

    Rows with a null ``announced`` are data; the others announce so many cells.
    A result waits for ``announcements`` of these.
    A partition announced with no cells gives the initial value.
    """
    kinds = dict(rows.dtypes)
    slim = rows.select(*keys, F.col(value).cast("double").alias("value"), F.col(announced).cast("long").alias("announced"))
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", total double, number long"

    def step(key, frames, state):
        for f in _step(key, frames, state, announcements):
            f.columns = [*keys, "total", "number"]
            f["total"] += initial
            yield f

    return slim.groupBy(*keys).applyInPandasWithState(step, out, "total double, seen long, expected long, announced long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window, with late rows accepted up to the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
