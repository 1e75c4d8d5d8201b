"""SimHash near-duplicates, linked through BK-trees.

A text's fingerprint takes each bit from the majority of its shingles' hashes.
Only different fingerprints are compared. Two that differ in at most ``radius``
bits agree on at least one of ``radius + 1`` blocks of bits, so the trees are
sharded by block and its value (with more blocks, by several of them, once there
are very many fingerprints): each shard's fingerprints go into one BK-tree,
whose children are keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius. A shard beyond SHARD_LIMIT is dealt
out in chunks, each chunk's tree searched by every chunk of the shard. A subtree
that lies in one component with the searcher is skipped, so that a dense group
costs no pairs; what leaves a shard is at most one link for each fingerprint.
Connected components then meet by alternating large and small stars.

Null and empty texts have no words and fingerprint zero, linked like any other.
Texts of fewer words than a shingle are one shingle. Repeated rows share a
fingerprint; ties (exactly half the hashes) leave a bit at zero; rows with a
null id get no component of their own but the smallest other id in theirs (null
if there is none). Empty tables give empty results; extra columns are ignored by
``near_duplicates`` and kept by ``without_copies``.

``without_copies`` takes links as candidates only. Two texts are copies if the
Jaccard similarity of their whole sets of five-word shingles is 0.8 or more, and
every pair that is joined has been verified or is connected by verified ones.
Such texts' fingerprints differ in more bits than blocks of bits could shard for
a large corpus, so its trees are sharded by the shingles themselves: a text is
in SLOTS shards, each named by its smallest shingle hash under an order of its
own, whatever the size of the corpus. Texts of similarity s share no shard with
probability (1 - s) ** SLOTS: under 3 in a million at 0.8. First the links that
span each shard's near fingerprints are verified, then those that span its texts
of similar marks (below), within chunks that differ from shard to shard: they
connect large groups. At last comes every pair of a shard within the radius whose
texts verified links don't already connect. For that, shards that lie in one group are done; one of over SHARD_TEXTS texts is sharded
once more by a second set of orders if that leaves fewer pairs to look at, and
what is large even so is dealt out in chunks, where a large group's chunks never
meet each other. Each text carries a mark, eight bits or more a shingle, set by their hashes, from which the search knows an upper bound of any
similarity: pairs that can't reach 0.8 never leave the task.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import BLOCK_BYTES, small_batches, stored

RADIUS = 3
SHINGLE = 3
SEED = 42
#: For ``without_copies``: fingerprints of the different words, which in texts of similar shingles differ least. Texts of five-word
#: similarity 0.8 share at least some 0.9 of their words by cosine, so that their fingerprints differ in 9 bits of 64 by
#: expectation, with a deviation of 2.8; the radius adds over two of these.
COPY_RADIUS = 16
COPY_SHINGLE = 5
#: Shards of each text, and most texts of one before it is sharded again or dealt out.
SLOTS = 8
SHARD_TEXTS = 1024
#: Least similarity of copies, as a fraction in whole numbers.
COPY_SIMILARITY = (4, 5)
#: Most fingerprints of one shard in one tree.
SHARD_LIMIT = 4096
#: Pairs that a search holds in memory before it hands them on.
PAIRS_AT_ONCE = 1 << 16
#: Parts in which the rows of a join on a hub of very many links are spread.
SALTS = 16
#: Two sets of SLOTS orders of hashes: multiplication by odd numbers, taken from the golden ratio.
_ORDERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3) | 1) & (1 << 64) - 1 for i in range(2 * SLOTS)], np.uint64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def xxh64_many(raw: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of ``raw``: those under 32 bytes in vector form, by length; longer ones one by one."""
    out = np.empty(len(starts), np.uint64)
    at8 = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,)).copy()
    order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(np.minimum(lengths, 32)[order], np.arange(34))
    for n in range(32):
        mine = order[bounds[n] : bounds[n + 1]]
        if not len(mine):
            continue
        at = starts[mine]
        h = np.full(len(mine), (seed + int(_P5) + n) & (1 << 64) - 1, np.uint64)
        p = 0
        while p + 8 <= n:
            h = _rotated(h ^ _rotated(at8[at + p] * _P2, 31) * _P1, 27) * _P1 + _P4
            p += 8
        rest = at8[at + p] if p < n else None
        if p + 4 <= n:
            h = _rotated(h ^ (rest & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
            rest = rest >> np.uint64(32)
            p += 4
        while p < n:
            h = _rotated(h ^ (rest & np.uint64(255)) * _P5, 11) * _P1
            rest = rest >> np.uint64(8)
            p += 1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        out[mine] = h ^ h >> np.uint64(32)
    for i in order[bounds[32] :].tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]], seed)
    return out


def _majority(hashes: np.ndarray) -> int:
    lanes = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _hashes_of(texts: list[str | None], shingle: int, distinct: bool = False):
    """(row, hashes of its shingles or different words) of every text that has words."""
    shingle = 1 if distinct else shingle
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush():
        raw = b" ".join(parts)
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(raw)]))
        begins = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        counts = np.maximum(np.diff(begins) - shingle + 1, 1)
        firsts = np.concatenate([b + np.arange(c) for b, c in zip(begins, counts)])
        lasts = np.minimum(firsts + shingle, np.repeat(begins[1:], counts)) - 1
        hashes = xxh64_many(raw, starts[firsts], ends[lasts] - starts[firsts])
        past = np.cumsum(counts)
        for row, a, b in zip(rows, past - counts, past):
            yield row, hashes[a:b]

    for i, t in enumerate(texts):
        words = (t or "").encode("utf-8", "replace").lower().split()
        joined = b" ".join(sorted(set(words)) if distinct else words)
        if not joined:
            continue
        rows.append(i)
        parts.append(joined)
        size += len(joined)
        if size >= BLOCK_BYTES:
            yield from flush()
            rows.clear()
            parts.clear()
            size = 0
    if parts:
        yield from flush()


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE, distinct: bool = False) -> np.ndarray:
    """64-bit SimHashes of whole texts: of their shingles, or (``distinct``) of their different words."""
    out = np.zeros(len(texts), np.uint64)
    for row, hashes in _hashes_of(texts, shingle, distinct):
        out[row] = _majority(hashes)
    return out


def shingle_sets_of(texts: list[str | None], shingle: int = COPY_SHINGLE) -> list[np.ndarray]:
    """The different hashed shingles of whole texts; none for a text without words."""
    out = [np.zeros(0, np.int64)] * len(texts)
    for row, hashes in _hashes_of(texts, shingle):
        out[row] = np.unique(hashes).view(np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) of every row."""

    def each(batches):
        for batch in batches:
            fps = fingerprints_of(batch.column(1).to_pylist(), shingle, distinct).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    small_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(each, f"id {kind}, fp long")


class LinkedTree:
    """A BK-tree that also keeps the components of what it holds.

    Each node has ``whole``: a member of the one component that its subtree
    lies in, or -1 once the subtree holds several.
    """

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.whole: list[int] = []
        self.parent: list[int] = []  # union-find

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def links(self, value: int) -> list[int]:
        """One node of each component of the tree that holds a fingerprint within the radius, as the search meets them."""
        out: list[int] = []
        if not self.values:
            return out
        seen: set[int] = set()
        radius, values, children, whole, find = self.radius, self.values, self.children, self.whole, self.find
        stack = [0]
        while stack:
            k = stack.pop()
            if (w := whole[k]) >= 0 and seen and find(w) in seen:
                continue
            d = (values[k] ^ value).bit_count()
            if d <= radius and (root := find(k)) not in seen:
                seen.add(root)
                out.append(k)
            kids = children[k]
            if kids:
                if len(kids) <= 2 * radius + 1:
                    stack.extend(c for e, c in kids.items() if -radius <= e - d <= radius)
                else:
                    stack.extend(c for e in range(d - radius, d + radius + 1) if (c := kids.get(e)) is not None)
        return out

    def add(self, value: int) -> list[int]:
        """Puts a fingerprint in, joined with what it links to; the values of those links."""
        near = self.links(value)
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.whole.append(new)
        self.parent.append(new)
        for k in near:
            self.parent[self.find(k)] = new
        at = 0
        while new:
            if (w := self.whole[at]) >= 0 and self.find(w) != new:
                self.whole[at] = -1
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                break
            at = below
        return [self.values[k] for k in near]


def _shard_links(batches, radius: int):
    """Rows (shard columns..., role, fp) in shard order, then by role: role 0 goes into the tree and links within it, role 1 only searches it."""
    shard, tree = None, LinkedTree(radius)
    for batch in batches:
        left, right = [], []
        for *key, role, fp in zip(*(c.to_pylist() for c in batch.columns)):
            if key != shard:
                shard, tree = key, LinkedTree(radius)
            u = fp & 0xFFFFFFFFFFFFFFFF
            for other in tree.links(u) if role else tree.add(u):
                left.append(fp)
                right.append(other - (1 << 64) if other >> 63 else other)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def mark_of(hashes: np.ndarray) -> bytes:
    """A bit for each different hash, by its lowest bits, among eight times as many or more (a power of two)."""
    bits = np.zeros(max(64, 1 << int(8 * max(1, len(hashes)) - 1).bit_length()), np.uint8)
    bits[(hashes.view(np.uint64) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Marked:
    """A text of a candidate search: node, group, number of shingles, and its mark."""

    __slots__ = ("node", "group", "size", "width", "bits", "spare")

    def __init__(self, node: int, group: int, size: int, mark: bytes):
        self.node, self.group, self.size, self.width = node, group, size, 8 * len(mark)
        self.bits = int.from_bytes(mark, "little")
        self.spare = size - self.bits.bit_count()  # shingles that share another's bit

    def may_equal(self, other: Marked) -> bool:
        """False only if the similarity can't be the least one: common shingles lie under common bits, one a bit but for spare ones."""
        x, y = (self, other) if self.width <= other.width else (other, self)
        bits, width, spare = y.bits, y.width, min(x.spare, y.spare)
        if width > x.width:  # folded to the narrower mark, some of the wider one's shingles share a bit
            while width > x.width:
                width >>= 1
                bits = bits >> width | bits & (1 << width) - 1
            spare = x.spare
        common = min((x.bits & bits).bit_count() + spare, x.size, y.size)
        up, down = COPY_SIMILARITY
        return down * common >= up * (x.size + y.size - common)


class CandidateTree:
    """A BK-tree of fingerprints that gives pairs of texts within the radius that may have the least similarity, but none of one group.

    It gives every such pair, or (``spanning``) takes each as a link that joins
    two groups, so that only pairs that connect something are given.
    """

    def __init__(self, radius: int = COPY_RADIUS, spanning: bool = False):
        self.radius, self.spanning = radius, spanning
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.texts: list[list[Marked]] = []  # of each fingerprint
        self.whole: list[int | None] = []  # the one group that a subtree lies in, or None
        self.joined: dict[int, int] = {}  # union-find of groups

    def find(self, group: int) -> int:
        joined = self.joined
        while (up := joined.get(group, group)) != group:
            joined[group] = joined.get(up, up)
            group = up
        return group

    def search(self, value: int, text: Marked) -> list[int]:
        """Texts of other groups within the radius that may have the least similarity."""
        out: list[int] = []
        radius, (up, down), size, find = self.radius, COPY_SIMILARITY, text.size, self.find
        group = find(text.group)
        stack = [0] if self.values else []
        while stack:
            k = stack.pop()
            if (w := self.whole[k]) is not None and find(w) == group:
                continue
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                for t in self.texts[k]:
                    if (other := find(t.group)) != group and down * min(t.size, size) >= up * max(t.size, size) and text.may_equal(t):
                        out.append(t.node)
                        if self.spanning:
                            self.joined[other] = group
            stack.extend(c for e, c in self.children[k].items() if -radius <= e - d <= radius)
        return out

    def add(self, value: int, text: Marked) -> None:
        at, group = 0, self.find(text.group)
        while self.values:
            if (w := self.whole[at]) is not None and self.find(w) != group:
                self.whole[at] = None
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                self.texts[at].append(text)
                return
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                break
            at = below
        self.values.append(value)
        self.children.append({})
        self.texts.append([text])
        self.whole.append(group)


def _shard_pairs(batches, radius: int, spanning: bool = False):
    """Rows (shard, low, high, role, fp, node, group, size, mark) in that order. Role 0 goes into the tree, and searches it where low is high; role 1 only searches."""
    shard, tree = None, CandidateTree(radius, spanning)
    for batch in batches:
        left, right = [], []

        def given():
            a, b = np.array(left, np.int64), np.array(right, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for *key, role, fp, node, group, size, mark in zip(*(c.to_pylist() for c in batch.columns)):
            if key != shard:
                shard, tree = key, CandidateTree(radius, spanning)
            u, text = fp & 0xFFFFFFFFFFFFFFFF, Marked(node, group, size, mark)
            if role or key[1] == key[2]:
                near = tree.search(u, text)
                left += [node] * len(near)
                right += near
            if not role:
                tree.add(u, text)
            if len(left) >= PAIRS_AT_ONCE:
                yield given()
                left.clear()
                right.clear()
        yield given()


def _shard_spans(batches, radius: int):
    """Rows (shard, chunk, fp, node) in that order: links that connect the near fingerprints of a chunk, at most one for each text and component."""
    shard, tree, same = None, LinkedTree(radius), {}
    for batch in batches:
        left, right = [], []
        for *key, fp, node in zip(*(c.to_pylist() for c in batch.columns)):
            if key != shard:
                shard, tree, same = key, LinkedTree(radius), {}
            if fp in same:  # the tree holds each fingerprint once
                left.append(node)
                right.append(same[fp])
                continue
            same[fp] = node
            for other in tree.add(fp & 0xFFFFFFFFFFFFFFFF):
                left.append(node)
                right.append(same[other - (1 << 64) if other >> 63 else other])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks (as signed longs) of all choices of ``blocks - radius`` blocks: two fingerprints within the radius agree under at least one."""
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in pairwise(bounds)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks enough that a shard of ``n`` evenly spread fingerprints stays in the hundreds. Any number above ``radius`` finds the same links."""
    blocks = radius + 1
    while blocks < 3 * radius and n >> round(64 * (blocks - radius) / blocks) > 256:
        blocks += 1
    return blocks


def _sharded(distinct: DataFrame, masks: list[int], limit: int) -> DataFrame:
    """Each fingerprint once for each shard and chunk: mask, part, low, high, role, fp, in that order."""
    each = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)]
    rows = distinct.select("fp", F.explode(F.array(*each)).alias("s")).select("fp", "s.mask", "s.part")
    # few shards are large: their table is written first, so that Spark knows its size and can spare the rows a shuffle
    large = rows.groupBy("mask", "part").count().where(F.col("count") > limit).select("mask", "part", F.ceil(F.col("count") / limit).cast("int").alias("chunks"))
    rows = rows.join(stored(large, "shards"), ["mask", "part"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # A row meets every chunk t of its shard in the pair (least, greatest) of its own chunk and t; the lower chunk is the tree.
    rows = rows.select("mask", "part", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("t"))
    rows = rows.select("mask", "part", F.least("own", "t").alias("low"), F.greatest("own", "t").alias("high"), (F.col("own") > F.col("t")).cast("int").alias("role"), "fp")
    shard = ["mask", "part", "low", "high"]
    return rows.repartition(*shard).sortWithinPartitions(*shard, "role", "fp")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints (column fp, each once) are within ``radius`` of each other."""
    masks = block_masks(radius, blocks or blocks_for(distinct.count(), radius))
    rows = _sharded(distinct.select("fp"), masks, limit)
    return rows.mapInArrow(lambda batches: _shard_links(batches, radius), "a long, b long")


def _by_key(texts: DataFrame, keys: str, *within: str) -> DataFrame:
    """Each row once for each of its keys, with ``shard``: the key and its slot (and those of ``within``) as one number; shards of one group only are left out."""
    rows = texts.select("*", F.posexplode(keys).alias("__slot", "__key")).drop(keys)
    rows = rows.withColumn("__shard", F.xxhash64(*within, "__slot", "__key")).drop("__slot", "__key", *within).withColumnRenamed("__shard", "shard")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("__low"), F.max("group").alias("__high"))
    return rows.join(sizes.where("__low < __high").select("shard", "n"), "shard")


def spanning_links(sharded: DataFrame, radius: int = COPY_RADIUS, limit: int = SHARD_TEXTS) -> DataFrame:
    """Links (a, b) between near nodes of the rows (shard, n, fp, node). A large shard's chunks are apart, but differ from slot to slot."""
    chunk = F.pmod(F.xxhash64("node", "shard"), F.ceil(F.col("n") / limit)).alias("chunk")
    rows = sharded.select("shard", chunk, "fp", "node").repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "fp", "node")
    return rows.mapInArrow(lambda batches: _shard_spans(batches, radius), "a long, b long")


def marked_links(texts: DataFrame, radius: int = COPY_RADIUS, limit: int = SHARD_TEXTS) -> DataFrame:
    """Links (a > b) that span the nodes of ``texts`` (fp, node, group, size, mark, keys) whose marks are similar, in the same way."""
    rows = _by_key(texts.select("fp", "node", "group", "size", "keys"), "keys").join(texts.select("node", "mark"), "node")
    chunk = F.pmod(F.xxhash64("node", "shard"), F.ceil(F.col("n") / limit))
    rows = rows.select("shard", chunk.alias("low"), chunk.alias("high"), F.lit(0).alias("role"), "fp", "node", "group", "size", "mark")
    rows = rows.repartition("shard", "low").sortWithinPartitions("shard", "low", "fp", "node")
    return rows.mapInArrow(lambda batches: _shard_pairs(batches, radius, True), "a long, b long")


def candidate_pairs(texts: DataFrame, radius: int = COPY_RADIUS, limit: int = SHARD_TEXTS) -> DataFrame:
    """Every pair (a > b) of nodes of ``texts`` (fp, node, group, size, mark, keys, more_keys) that share a shard and are within ``radius``; none within a group, none whose sizes or marks exclude the least similarity. Pairs may repeat."""
    cols = ["fp", "node", "group", "size"]
    rows = stored(_by_key(texts.select(*cols, "keys"), "keys"), "shards")
    small = rows.where(F.col("n") <= limit).select("shard", *cols)
    crowd = rows.where(F.col("n") > limit).withColumnRenamed("shard", "first")
    again = crowd.select("first", F.col("first").alias("shard"), *cols).join(texts.select("node", "more_keys"), "node")
    again = stored(_by_key(again, "more_keys", "shard"), "more_shards")
    # a second sharding is taken where it leaves fewer pairs; texts that are all alike would only meet again and again
    pairs = again.groupBy("first", "shard").agg(F.first("n").cast("double").alias("n")).groupBy("first").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    pairs = crowd.groupBy("first").agg(F.first("n").cast("double").alias("n")).join(pairs, "first", "left")
    direct = stored(pairs.where(F.col("pairs") >= F.col("n") * F.col("n")).select("first"), "direct")
    again = again.join(direct, "first", "left_anti").drop("first").unionByName(crowd.join(direct, "first", "left_semi").withColumnRenamed("first", "shard"))
    small = small.unionByName(again.where(F.col("n") <= limit).select("shard", *cols))
    zero = F.lit(0).cast("long")
    small = small.select("shard", zero.alias("low"), zero.alias("high"), F.lit(0).alias("role"), *cols)
    # What is large even so is dealt out in chunks of one large group each, or of all the rest, and the chunks meet in pairs.
    large = again.where(F.col("n") > limit)
    sizes = large.groupBy("shard", "group").count().withColumn("own", F.when(F.col("count") > limit, F.col("group")))
    sizes = sizes.groupBy("shard", "own").agg(F.ceil(F.sum("count") / limit).alias("chunks"))
    sizes = stored(sizes, "chunks")
    chunks = sizes.select("shard", "own", F.explode(F.sequence(F.lit(1).cast("long"), "chunks")).alias("t")).select("shard", "own", F.xxhash64("own", "t").alias("chunk"))
    low, high = (chunks.select("shard", F.col("own").alias(f"{c}_own"), F.col("chunk").alias(c)) for c in ("low", "high"))
    meet = low.join(high, "shard").where((F.col("low") <= F.col("high")) & (F.col("low_own").isNull() | F.col("high_own").isNull() | (F.col("low_own") != F.col("high_own")))).select("shard", "low", "high")
    parts = large.join(sizes.where("own is not null").select("shard", F.col("own").alias("group"), F.col("chunks").alias("mine")), ["shard", "group"], "left")
    parts = parts.join(sizes.where("own is null").select("shard", F.col("chunks").alias("rest")), "shard", "left")
    parts = parts.select("shard", *cols, F.xxhash64(F.when(F.col("mine").isNotNull(), F.col("group")), F.pmod(F.xxhash64("node"), F.coalesce("mine", "rest")) + 1).alias("chunk"))
    ends = meet.select("shard", F.col("low").alias("chunk"), "low", "high", F.lit(0).alias("role")).unionByName(meet.where("low <> high").select("shard", F.col("high").alias("chunk"), "low", "high", F.lit(1).alias("role")))
    parts = parts.join(ends, ["shard", "chunk"]).select("shard", "low", "high", "role", *cols)
    shard = ["shard", "low", "high"]
    marked = small.unionByName(parts).join(texts.select("node", "mark"), "node").select(*shard, "role", *cols, "mark")
    dealt = marked.repartition(*shard).sortWithinPartitions(*shard, "role", "fp", "node")
    return dealt.mapInArrow(lambda batches: _shard_pairs(batches, radius), "a long, b long")


def _spread_join(rows: DataFrame, few: DataFrame, key: str, by: str, how: str) -> DataFrame:
    """``rows`` joined with ``few`` (one row a key), the rows of each key spread over SALTS tasks: a key may be a hub of very many rows."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the smallest node that it is connected with.

    Alternates large stars (each node hands its larger neighbours to its
    smallest) and small stars (its smaller ones), until nothing changes; each
    round's links are written to the shared folder.
    """
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "links")
    before = None
    for _ in range(most_rounds):
        # every edge (a > b) hands a to the smallest neighbour of b, or to b itself where b has no smaller one
        low = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
        large = _spread_join(now, low, "b", "a", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """id, fp and component (the smallest id reachable through links) of every row."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle, distinct), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    # roots has a row for each linked fingerprint but the roots themselves
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = stored(grouped, "grouped")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = stored(_spread_join(grouped, smallest, "root", "fp", "inner").select("fp", "component"), "components")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_sets(texts: DataFrame, shingle: int = COPY_SHINGLE) -> DataFrame:
    """node, fp, size, shingles (different hashes) and mark of ``texts`` (node, fp, text)."""

    def each(batches):
        for batch in batches:
            sets = shingle_sets_of(batch.column(2).to_pylist(), shingle)
            sizes = np.array([len(x) for x in sets], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], sizes.cumsum())), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            marks = pa.array([mark_of(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), lists, marks], names=["node", "fp", "size", "shingles", "mark"])

    small_batches(texts.sparkSession)
    return texts.select("node", "fp", "text").mapInArrow(each, "node long, fp long, size int, shingles array<long>, mark binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose shingles have the least similarity."""
    up, down = COPY_SIMILARITY
    left, right = (sets.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("shingles").alias(f"{c}_shingles")) for c in "ab")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("size").alias("least")), "b").join(left, "a")
    both = both.where(down * F.least("least", "a_size") >= up * F.greatest("least", "a_size")).drop("least").join(right, "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return both.where(down * common >= up * (F.col("a_size") + F.col("b_size") - common)).select("a", "b")


def sketches_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint of the different words, number of different shingles, and the smallest shingle hash under each of the orders (zeros without words), of whole texts."""
    sizes, least = np.zeros(len(texts), np.int32), np.zeros((len(texts), len(_ORDERS)), np.uint64)
    for row, hashes in _hashes_of(texts, COPY_SHINGLE):
        h = np.unique(hashes)
        sizes[row] = len(h)
        for a in range(0, len(h), BLOCK_BYTES >> 7):
            some = (h[a : a + (BLOCK_BYTES >> 7), None] * _ORDERS).min(axis=0)
            least[row] = np.minimum(least[row], some) if a else some
    return fingerprints_of(texts, distinct=True), sizes, least.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (the text's md5), fp, size, keys and more_keys of every row."""

    def each(batches):
        for batch in batches:
            fps, sizes, least = sketches_of(batch.column(2).to_pylist())
            ends = pa.array(np.arange(len(fps) + 1) * SLOTS, pa.int32())
            keys = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part).ravel())) for part in (least[:, :SLOTS], least[:, SLOTS:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64)), pa.array(sizes), *keys], names=["id", "key", "fp", "size", "keys", "more_keys"])

    small_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"id {kind}, key string, fp long, size int, keys array<long>, more_keys array<long>")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = COPY_RADIUS, limit: int = SHARD_TEXTS) -> DataFrame:
    """id, key (the text's md5) and group (a number) of every row; equal texts and verified copies are connected."""
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    # each different text is a node; the numbers are fixed once they are written
    nodes = rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("fp", "size", "keys", "more_keys"))).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes.withColumn("group", F.col("node")), "texts")
    # what spans the near fingerprints comes first: it connects large groups of copies without all their pairs
    sharded = stored(_by_key(nodes.select("fp", "node", "group", "keys"), "keys"), "shards")
    span = stored(spanning_links(sharded, radius, limit).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "spans")
    # a text that no span meets is near no other, unless chunks kept them apart: only the rest are looked up again, and have their shingles fetched
    met = span.select(F.col("a").alias("node")).unionByName(span.select(F.col("b").alias("node"))).unionByName(sharded.where(F.col("n") > limit).select("node"))
    met = stored(met.distinct(), "met")
    near = stored(nodes.join(met, "node", "left_semi"), "near")
    texts = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text")).join(near.select("key", "node", "fp"), "key").dropDuplicates(["node"])
    sets = stored(shingle_sets(texts), "shingles")
    sure = stored(verified(span, sets), "verified")
    near = stored(near.drop("group").join(sets.select("node", "mark"), "node"), "marked")

    def grouped(known: DataFrame) -> DataFrame:
        return stored(near.join(components(known), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root"), "grouped")

    more = stored(marked_links(grouped(sure), radius, limit).distinct(), "more_spans")
    sure = sure.unionByName(stored(verified(more, sets), "verified"))
    rest = stored(candidate_pairs(grouped(sure), radius, limit).distinct(), "pairs")
    roots = components(sure.unionByName(verified(rest, sets)))
    groups = stored(nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("group")), "groups")
    return rows.select("id", "key").join(groups, "key").select("id", "key", "group")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = COPY_RADIUS) -> DataFrame:
    """``docs`` with one row of each group of verified copies: of smallest id, then of least md5 of its text. Rows without an id stay."""
    least = copies(docs, id_col, text_col, radius).where(F.col("id").isNotNull()).groupBy("group").agg(F.min(F.struct("id", "key")).alias("row"))
    stays = least.select(F.col("row.id").alias("__id"), F.col("row.key").alias("__key"))
    # equal rows, or rows that differ in other columns only
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(*(c for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind), F.lit(0)))
    keyed = docs.withColumn("__key", F.md5(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__id", F.col(id_col))
    kept = keyed.join(stays, ["__id", "__key"], "left_semi").withColumn("__first", first).where(F.col("__first") == 1).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
