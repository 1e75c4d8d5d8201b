"""Exact top-k by Hamming distance: incremental multi-index hashing.

Codes of BITS bits are split into segments of about log2(number of codes) bits,
each with a table of its own. The search radius s grows by rounds (0 and 1 share
the first): every query that is still open looks up, in each of the m segments,
the values that differ from its own in exactly s bits. A code that wasn't met up to s
differs in at least s + 1 bits in each segment, so that every code up to distance
m * (s + 1) - 1 has been met; a query is closed when its kth verified distance is
covered. No code is compared that no segment's table gave.

A segment's table is sharded by the leading bits of the segment, so that a shard
holds some SHARD codes; a query visits the shards whose leading bits differ by at
most s from its own, and looks up the rest of the radius there. A shard that
holds more is dealt out in chunks, and the visits of much visited ones in
batches. Only codes, ids and visits are shuffled; what leaves a visit is at most
k + 1 rows, and each round's k best rows of each query are written to the shared
folder.

Rows that share a code are held once, with their k + 1 smallest ids, which loses
nothing: ties are broken by id. Rows with a null code are in no result, as a
query or a neighbour; a query doesn't find itself (by id); with fewer than k
others it gets them all. Rows of equal id and code count once; an id with several
codes is asked once for each. An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import stored

BITS = 64
#: Codes that a shard is meant to hold; one that holds over twice as many is dealt out in chunks.
SHARD = 1 << 14
#: Most visits that one batch of a shard's chunk answers.
VISITS = 1 << 16


def sign_code(column: str):
    """64-bit code of an array column: bit i is set where element i is over zero (a null element is not). More than 64 elements are an error."""
    bits = F.transform(column, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(column) > BITS, F.raise_error(F.lit(f"sign codes hold {BITS} elements at most")).cast("long")).when(F.col(column).isNotNull(), code)


@lru_cache(maxsize=256)
def flips(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with exactly ``radius`` set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], dtype=np.int64)


class Segments:
    """How codes are split: bounds of the segments, and how many leading bits of each make its shard."""

    def __init__(self, codes: int, shard: int = SHARD, segments: int | None = None):
        m = segments or max(1, round(BITS / max(4.0, log2(max(2, codes)))))
        cuts = [round(BITS * i / m) for i in range(m + 1)]
        self.lows, self.widths = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:])]
        self.leads = [min(w, int(log2(max(1, codes / shard)))) for w in self.widths]

    def __len__(self) -> int:
        return len(self.widths)

    def value(self, codes, j: int):
        return (codes >> np.uint64(self.lows[j])) & np.uint64((1 << self.widths[j]) - 1)

    def lead(self, codes, j: int):
        return (self.value(codes, j) >> np.uint64(self.widths[j] - self.leads[j])).astype(np.int64)

    def rest(self, codes, j: int):
        return (self.value(codes, j) & np.uint64((1 << (self.widths[j] - self.leads[j])) - 1)).astype(np.int64)

    def covered(self, radius: int) -> int:
        """Largest distance up to which every code has been met once ``radius`` is done in all segments."""
        return len(self) * (radius + 1) - 1


class Shard:
    """The codes of one shard (or a chunk of it) of segment ``j``, by the rest of the segment's value."""

    def __init__(self, split: Segments, j: int, codes: np.ndarray):
        self.split, self.j, self.codes = split, j, codes
        part = split.rest(codes, j)
        self.order = np.argsort(part, kind="stable")
        self.values, firsts = np.unique(part[self.order], return_index=True)
        self.bounds = np.append(firsts, len(codes))

    def met(self, query: np.uint64, lead: int, radius: int) -> np.ndarray:
        """Positions of codes whose segment differs from the query's in exactly ``radius`` bits."""
        left = radius - int(self.split.lead(query, self.j) ^ lead).bit_count()
        width = self.split.widths[self.j] - self.split.leads[self.j]
        if not 0 <= left <= width:
            return np.zeros(0, np.int64)
        probes = flips(width, left) ^ int(self.split.rest(query, self.j))
        at = np.searchsorted(self.values, probes)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == probes]
        if not len(at):
            return np.zeros(0, np.int64)
        n = self.bounds[at + 1] - self.bounds[at]
        past = n.cumsum()
        return self.order[np.repeat(self.bounds[at] - past + n, n) + np.arange(past[-1])]


def _best(distance: np.ndarray, found: np.ndarray, ids: list[list[int]], most: int) -> list[tuple[int, int, int]]:
    """The ``most`` nearest rows among the found codes, as (distance, id, position of the code)."""
    order = np.argsort(distance, kind="stable")
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(order) and len(out) < most:
        d = distance[order[at]]
        past = at + int(np.searchsorted(distance[order[at:]], d, side="right"))
        tied = [(int(d), i, p) for p in found[order[at:past]].tolist() for i in ids[p]]
        out += sorted(tied)[: most - len(out)]
        at = past
    return out


def _visits(asked: DataFrame, split: Segments, radius: int) -> DataFrame:
    """Each query (id, code) with every shard (segment, lead) that may hold codes at ``radius`` in that segment."""

    def each(batches):
        for batch in batches:
            codes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for j in range(len(split)):
                for p in range(min(radius, split.leads[j]) + 1):
                    masks = flips(split.leads[j], p)
                    for a in range(0, len(codes), max(1, (1 << 18) // len(masks))):
                        some = slice(a, a + max(1, (1 << 18) // len(masks)))
                        leads = (split.lead(codes[some], j)[:, None] ^ masks).ravel()
                        row = pa.array(np.repeat(np.arange(len(codes))[some], len(masks)))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(len(leads), j, np.int32)), pa.array(leads)], names=["id", "code", "segment", "lead"])

    return asked.mapInArrow(each, "id long, code long, segment int, lead long")


def _tables(by_code: DataFrame, split: Segments) -> DataFrame:
    """Each code with its ids, once for each segment: segment, lead, code, ids."""
    whole = F.col("code")

    def lead(j: int):
        shift = split.lows[j] + split.widths[j] - split.leads[j]
        moved = F.shiftrightunsigned(whole, shift) if shift < BITS else F.lit(0).cast("long")
        return moved.bitwiseAND(F.lit((1 << split.leads[j]) - 1 if split.leads[j] < BITS else -1).cast("long"))

    places = F.array(*(F.struct(F.lit(j).alias("segment"), lead(j).alias("lead")) for j in range(len(split))))
    return by_code.select(F.explode(places).alias("s"), "code", "ids").select("s.segment", "s.lead", "code", "ids")


def _unusual(rows: DataFrame, of: str, most: int, limit: int, bound: int) -> DataFrame | None:
    """segment, lead and ``of``: in how many parts of ``limit`` rows the shards with more than ``most`` fall. None if no shard can have so many (``bound``)."""
    if bound <= most:
        return None
    found = rows.groupBy("segment", "lead").count().where(F.col("count") > most)
    return stored(found.select("segment", "lead", F.ceil(F.col("count") / limit).cast("int").alias(of)), of)


def _round(tables: DataFrame, chunks: DataFrame | None, visits: DataFrame, batches: DataFrame | None, split: Segments, radius: int, k: int) -> DataFrame:
    """query_id, query_code, neighbor_id, distance, code: at most k + 1 rows of each visit. Every chunk of a shard meets every batch of its visits once."""
    shard = ["segment", "lead"]

    def dealt(rows: DataFrame, role: int, ids) -> DataFrame:
        rows = rows.select(*shard, F.lit(role).alias("role"), "code", ids.alias("ids"), F.xxhash64("code", ids).alias("key"))
        for own, sizes, mine in (("chunk", chunks, not role), ("batch", batches, bool(role))):
            if sizes is None:
                rows = rows.withColumn(own, F.lit(0))
                continue
            n = F.coalesce(sizes.columns[-1], F.lit(1))
            rows = rows.join(sizes, shard, "left").withColumn(own, F.pmod("key", n).cast("int") if mine else F.explode(F.sequence(F.lit(0), n - 1))).drop(sizes.columns[-1])
        return rows.select(*shard, "chunk", "batch", "role", "code", "ids")

    both = dealt(tables, 0, F.col("ids")).unionByName(dealt(visits, 1, F.array("id")))
    both = both.repartition(*shard, "chunk", "batch").sortWithinPartitions(*shard, "chunk", "batch", "role", "code")

    def answer(stream):
        at, codes, ids, index = None, [], [], None
        for b in stream:
            out: list[tuple[int, ...]] = []
            for j, lead, chunk, batch, role, code, own in zip(*(c.to_pylist() for c in b.columns)):
                if (j, lead, chunk, batch) != at:
                    at, codes, ids, index = (j, lead, chunk, batch), [], [], None
                if not role:
                    codes.append(code)
                    ids.append(own)
                    continue
                if not codes:
                    continue
                if index is None:
                    index = Shard(split, j, np.array(codes, np.int64).view(np.uint64))
                query = np.int64(code).astype(np.uint64)
                found = index.met(query, lead, radius)
                distance = np.bitwise_count(index.codes[found] ^ query)
                # the query itself may be among them
                out += [(own[0], code, i, d, codes[p]) for d, i, p in _best(distance, found, ids, k + 1) if i != own[0]]
            cols = list(map(list, zip(*out))) if out else [[] for _ in range(5)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "query_code", "neighbor_id", "distance", "code"])

    return both.mapInArrow(answer, "query_id long, query_code long, neighbor_id long, distance int, code long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", code_col: str = "code", shard: int = SHARD, segments: int | None = None) -> DataFrame:
    """query_id, neighbor_id, distance, rank: the k rows nearest to each query, ties by id.

    ``rows`` and ``queries`` have a whole-number id and a long code.
    """
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).alias("code")).where("id is not null and code is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).alias("code")).where("id is not null and code is not null")
    # the k + 1 smallest ids of each code: partly per task and id bucket first, so that a code with many rows meets in no single task
    first = Window.partitionBy("code", F.pmod("id", F.lit(64))).orderBy("id")
    some = known.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    by_code = stored(some.groupBy("code").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids")), "codes")
    n = by_code.count()
    split = Segments(n, shard, segments)
    tables = _tables(by_code, split)
    chunks = _unusual(tables, "chunks", 2 * shard, shard, n)
    left = stored(asked.distinct(), "queries")
    waiting, met, closed, radius = left.count(), None, [], 0
    query = ["query_id", "query_code"]
    order = Window.partitionBy(*query).orderBy("distance", "neighbor_id", "code")
    while True:
        visits = _visits(left, split, radius)
        near = _round(tables, chunks, visits, _unusual(visits, "batches", VISITS, VISITS, waiting), split, radius, k)
        near = (near if met is None else near.unionByName(met)).dropDuplicates([*query, "neighbor_id", "code"])
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        last = radius == max(split.widths)
        sure = F.lit(last) | (F.count(F.when(F.col("distance") <= split.covered(radius), 1)).over(Window.partitionBy(*query)) >= k)
        best = stored(near.withColumn("sure", sure), "best")
        closed.append(best.where("sure").select("query_id", "neighbor_id", "distance", "rank"))
        done = best.where("sure and rank = 1").select(F.col("query_id").alias("id"), F.col("query_code").alias("code"))
        waiting -= done.count()
        if last or not waiting:
            break
        left = left.join(done, ["id", "code"], "left_anti")
        met = best.where("not sure").drop("rank", "sure")
        radius += 1
    return reduce(DataFrame.unionByName, closed)


def embedding_neighbours(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows, by sign code, of every row whose vec_id is divisible by 100."""
    rows = embeddings.select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(rows, rows.where(F.col("id") % 100 == 0), k)


EMBEDDING_NEIGHBOURS_SQL = """
with c as (
  select vec_id, list_reduce(list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then cast(1 as ubigint) << (i - 1) else cast(0 as ubigint) end), lambda a, b: a | b) as code
  from embeddings where embedding is not null and vec_id is not null
), d as (
  select q.vec_id as query_id, r.vec_id as neighbor_id, cast(bit_count(xor(q.code, r.code)) as integer) as distance
  from c q join c r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id
), o as (
  select *, cast(row_number() over (partition by query_id order by distance, neighbor_id) as integer) as rank from d
)
select query_id, neighbor_id, distance, rank from o where rank <= 10
"""
