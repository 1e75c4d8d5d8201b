"""Best-fit packing with several capacities.

Documents are tokenized whole and end with a separator id; only documents longer
than a sequence are cut. A bin (sequence) has three capacities: tokens, pieces
(PIECES), and attention cost, the sum of squared piece lengths (ATTENTION times
the squared token capacity; a single piece that costs more can't be divided and
gets a bin of its own). Pieces are placed largest first into the open bin, among those with room under every capacity, whose
weighted residual vector has the smallest norm after placing (``rule="norm"``)
or the largest dot product with the piece (``rule="dot"``).

Pieces are dealt out evenly, in turn, some PIECES_PER_TASK to a task; each task
packs its own bins, so what is lost to partly filled bins is about one bin a task.

Null and empty texts are one piece, the separator. Ties go to the bin opened
first, and equal pieces are placed in order of id and piece. Repeated rows and
ids are packed as rows of their own; null ids sort first. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import small_batches, stored
from strata.llm.tokens import encoder, vocabulary

TOKENS = 2048
#: Most pieces of a sequence. It costs sequences only where pieces have under TOKENS / PIECES = 16 tokens on average.
PIECES = 128
#: Most attention cost of a sequence of several pieces, as a share of the squared token capacity.
ATTENTION = 15 / 16
PIECES_PER_TASK = 20_000
WEIGHTS = (1.0, 0.05, 0.02)
SEPARATOR = 0


def pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, separator: int = SEPARATOR, with_ids: bool = True) -> DataFrame:
    """id, piece, start, length, ids_crc32 and (``with_ids``) ids, little-endian unsigned 32-bit, of each piece."""
    path = tokenizer or vocabulary("word_bpe_49k.json")

    def cut(batches):
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            enc = encoder(path)
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = enc.encode_one(text) + end
                n = len(raw) // 4
                for k, at in enumerate(range(0, n, tokens)):
                    part = raw[4 * at : 4 * (at + tokens)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    small_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, tokens: int = TOKENS, most_pieces: int = PIECES, attention: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece. ``lengths`` must not exceed ``tokens``; pieces are placed largest first, equal ones in order.

    ``attention``: most sum of squared lengths (None: ATTENTION of the squared capacity); a longer piece is alone in its bin.
    """
    attention = ATTENTION * float(tokens) ** 2 if attention is None else float(attention)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    if lengths.max() > tokens or most_pieces < 1:
        raise ValueError("a piece exceeds the capacity of an empty bin")
    order = np.argsort(-lengths, kind="stable")
    room = max(64, n // 4)
    state = np.zeros((3, room))  # residual tokens, pieces, attention of each open bin, scaled to 1
    name = np.zeros(room, np.int64)
    opened, made = 0, 0
    scale = np.array([tokens, most_pieces, attention], dtype=float)
    w = np.array(weights) ** 2 if rule == "norm" else np.array(weights)
    least = int(lengths.min())
    floor = np.array([least, 1.0, float(least) ** 2]) / scale - 1e-12
    full = tokens - least
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1.0, float(size) ** 2]) / scale
        best = -1
        if size <= full and opened:
            left = state[:, :opened] - need[:, None]
            fits = left.min(axis=0) >= -1e-9
            if fits.any():
                if rule == "norm":
                    value = np.where(fits, w @ (left * left), np.inf)
                    best = int(value.argmin())
                else:
                    value = np.where(fits, (w * need) @ state[:, :opened], -np.inf)
                    best = int(value.argmax())
        if best < 0:
            if opened == len(name):
                state, name = np.concatenate([state, np.zeros_like(state)], axis=1), np.concatenate([name, np.zeros_like(name)])
            best, name[opened] = opened, made
            state[:, opened] = 1.0
            opened, made = opened + 1, made + 1
        bins[i], offsets[i] = name[best], round(tokens * (1 - state[0, best]))
        state[:, best] -= need
        if (state[:, best] < floor).any():  # nothing that is left to place fits: closed
            opened -= 1
            state[:, best : opened], name[best : opened] = state[:, best + 1 : opened + 1].copy(), name[best + 1 : opened + 1].copy()
    return bins, offsets


def pack(parts: DataFrame, tokens: int = TOKENS, most_pieces: int = PIECES, attention: float | None = None, rule: str = "norm", per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``parts`` (id, piece, length and more) with sequence_id and offset."""
    n = parts.count()
    tasks = max(1, -(-n // per_task))
    keep = parts.columns
    at = keep.index("length")

    def each(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        base = TaskContext.get().partitionId() << 32
        bins, offsets = best_fit(table.column(at).to_numpy(), tokens, most_pieces, attention, rule=rule)
        table = table.append_column("sequence_id", pa.array(bins + base, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{k}` {v}" for k, v in parts.dtypes) + ", sequence_id long, offset long"
    # in turn, not by a hash: equal rows, however many, are spread like others
    dealt = parts.repartition(tasks).sortWithinPartitions("id", "piece", "ids_crc32")
    return dealt.mapInArrow(each, schema)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, tokens: int = TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    parts = stored(pieces(docs, tokenizer, tokens=tokens, with_ids=False), "pieces")
    return pack(parts, tokens).withColumnRenamed("id", "doc_id")


def sequences(docs: DataFrame, tokenizer: str | None = None, tokens: int = TOKENS) -> DataFrame:
    """sequence_id, length, doc_ids, offsets and ids (one binary of little-endian unsigned 32-bit ids) of every packed sequence."""
    placed = pack(stored(pieces(docs, tokenizer, tokens=tokens), "pieces"), tokens)
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "id", "ids", "length"))).alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), F.col("p")["id"].alias("doc_ids"), F.col("p")["offset"].alias("offsets"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
