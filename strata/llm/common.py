"""What the text operators share: scratch space, labelled samples, text buffers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most bytes of text that one vectorised step handles at once in a Python worker.
BLOCK_BYTES = 1 << 20

BATCH_ROWS = 1000

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, as in local tests, a folder of our own is chosen.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "" not in _scratch:
        _scratch[""] = "file://" + tempfile.mkdtemp(prefix="strata-")
        atexit.register(_remove_local, _scratch[""])
    return _scratch[""]


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/strata/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python at most BATCH_ROWS rows at a time, so that long ones don't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fold_of(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def sample_of(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, chars: int) -> list[tuple[str, object]]:
    """(text, label) of the picked ids, in id order (null: empty); of a longer text, ``chars`` code points from its middle. ``picked`` (id, label) is bounded by its caller's limit."""
    p = picked.select(F.col(picked.columns[0]).alias("__id"), F.col(picked.columns[1]).alias("__label"))
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    middle = F.substring("__text", F.greatest(F.lit(1), F.floor((F.length("__text") - chars) / 2) + 1).cast("int"), F.lit(chars))
    rows = d.join(F.broadcast(p), "__id").select("__id", middle.alias("__text"), "__label").collect()
    return [(r["__text"], r["__label"]) for r in sorted(rows, key=lambda r: (r["__id"], r["__text"]))]


def lowest_by_group(df: DataFrame, id_col: str, group: str, n: int) -> DataFrame:
    """At most ``n`` rows of each group, those whose hashed id is smallest, as (id, group): the same ones on every run.

    Each task keeps its own ``n`` first (a window group limit), so that a large group is nowhere gathered.
    """
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col))
    return df.select(id_col, group).distinct().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def lowest_by_hash(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` rows, those whose hashed id is smallest: the same ones on every run."""
    return df.orderBy(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)).limit(n)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column, and the n + 1 offsets of its rows. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans_of_rows(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 60, share: float = 0.5) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton's method with halved steps. Label 1 has ``share`` of the weight, however many rows each label has."""
    x = np.hstack([np.ones((len(features), 1)), features])
    w = np.zeros(x.shape[1])
    own = labels.mean()
    each = np.where(labels > 0, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9))
    penalty = np.full(x.shape[1], ridge * max(1, len(x)))
    penalty[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(each @ (np.logaddexp(0, z) - labels * z) + 0.5 * (penalty * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (each * (p - labels)) + penalty * w
        hessian = (x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - then < 1e-9 * (1 + abs(now)):
            break
        w, now = w - size * step, then
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
