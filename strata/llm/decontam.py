"""Benchmark decontamination.

The normalised word windows of the benchmark texts are hashed into one set,
which is broadcast after a check of its size. Every document's words and window
hashes are computed in vector form over whole texts; the rare hash hits are
verified word by word. Hits mark word spans, which are removed, or condemn the
whole document.

A benchmark whose set would outgrow SET_BYTES is dealt into several sets, scanned
one after another; driver and workers hold one at a time. All hits of a text are
merged before anything is cut or judged, so that the number of sets changes
nothing.

A word is a run of digits, letters and non-ASCII characters, A-Z lower-cased. A
window is ``width`` consecutive words of an item; an item with fewer words, but
not none, is one window. Null and empty texts have no words. Ties: a window of
several items counts for each of them. An item without an id is named None.
Repeated rows get equal results. Empty
tables: no documents give an empty result, no items leave all clean. Extra
columns are ignored by ``scan_benchmark`` and kept by ``without_benchmark``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import small_batches, spans_of_rows, stored, text_buffers

WIDTH = 10
#: Most bytes of one broadcast set (one item's windows are never parted).
SET_BYTES = 256 << 20
#: Bytes of the set for a byte of benchmark text, at most: at one word of one byte every two bytes.
SET_SHARE = 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def word_bounds(lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes; rows must be separated by a byte that is no word."""
    inside = np.empty(len(lowered) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _WORD[lowered]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of running polynomial sums, brought to a common exponent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    reach = int(lengths.max())
    powers = _powers(_BASE, reach)
    if reach <= 64:
        h = np.zeros(len(starts), np.uint64)
        for k in range(reach):
            at = np.flatnonzero(lengths > k)
            h[at] += (lowered[starts[at] + k].astype(np.uint64) + np.uint64(1)) * powers[k]
    else:
        h = np.empty(len(starts), np.uint64)
        short = np.flatnonzero(lengths <= 64)
        h[short] = 0
        for k in range(64):
            at = short[lengths[short] > k]
            h[at] += (lowered[starts[at] + k].astype(np.uint64) + np.uint64(1)) * powers[k]
        for i in np.flatnonzero(lengths > 64):
            h[i] = ((lowered[starts[i] : ends[i]].astype(np.uint64) + np.uint64(1)) * powers[: lengths[i]]).sum(dtype=np.uint64)
    return _mix(h + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes (one shorter than ``words`` by width - 1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _STEP + words[k : k + n]
    return h


@dataclass
class WindowSet:
    """The windows of some items, as places in the items' words: 16 bytes a window, and the words once."""

    names: list[str]
    texts: list[bytes]  # of each item: its words, joined by spaces
    words: list[np.ndarray]  # where each word begins there, and one past the last
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by window length: sorted hashes, item and first word of each

    def having(self, width: int, hashed: np.uint64, text: bytes) -> set[str]:
        """Names of the items that have this very window."""
        hashes, items, firsts = self.tables[width]
        a, b = np.searchsorted(hashes, hashed, side="left"), np.searchsorted(hashes, hashed, side="right")
        out = set()
        for i, first in zip(items[a:b].tolist(), firsts[a:b].tolist()):
            at = self.words[i]
            if self.texts[i][at[first] : at[first + width] - 1] == text:
                out.add(self.names[i])
        return out


def normal_words(text: str | None) -> list[bytes]:
    """The words of one text, plainly."""
    low = _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)]
    starts, ends = word_bounds(low)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)]


def window_set(items: list[tuple[object, str | None]], width: int = WIDTH) -> WindowSet:
    """Of bounded (item id, text) pairs."""
    out = WindowSet([], [], [], {})
    parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for item, text in items:
        words = normal_words(text)
        if not words:
            continue
        raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
        starts, ends = word_bounds(raw)
        n, number = min(width, len(words)), len(out.names)
        h = window_hashes(word_hashes(raw, starts, ends), n)
        parts.setdefault(n, []).append((h, np.full(len(h), number, np.int32), np.arange(len(h), dtype=np.int32)))
        out.names.append(str(item))
        out.texts.append(raw.tobytes())
        out.words.append(np.append(starts, len(raw) + 1).astype(np.int32))
    for n, found in parts.items():
        h, number, first = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(h, kind="stable")
        out.tables[n] = h[order], number[order], first[order]
    return out


def _in_sorted(h: np.ndarray, table: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """Positions of values that occur in a sorted table; a bit table by the top 20 bits rules most out."""
    maybe = np.flatnonzero(coarse[(h >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(table, h[maybe])
    at[at == len(table)] = 0
    return maybe[table[at] == h[maybe]]


class Scanner:
    """Finds the windows of a set in batches of texts."""

    def __init__(self, known: WindowSet):
        self.known, self.coarse = known, {}
        for n, (table, *_) in known.tables.items():
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(table >> np.uint64(44)).astype(np.int64)] = True
            self.coarse[n] = bits

    def rows(self, column: pa.Array):
        """For each row: number of words, the hits as merged (first, past last word, first, past last byte), and the items they are of."""
        data, offsets = text_buffers(column)
        for a, b in spans_of_rows(offsets):
            yield from self._block(data, offsets[a : b + 1])

    def _block(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        padded = np.full(int(lengths.sum()) + n, 32, dtype=np.uint8)  # a space after each row
        begins = offsets[:-1] - offsets[0] + np.arange(n)
        keep = np.ones(len(padded), dtype=bool)
        keep[begins + lengths] = False
        padded[keep] = _LOWER[data[offsets[0] : offsets[-1]]]
        starts, ends = word_bounds(padded)
        row = np.searchsorted(begins, starts, side="right") - 1
        firsts = np.searchsorted(row, np.arange(n + 1))
        hashes = word_hashes(padded, starts, ends)
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        raw = None
        for width in sorted(self.known.tables):
            h = window_hashes(hashes, width)
            if not len(h):
                continue
            for i in _in_sorted(h, self.known.tables[width][0], self.coarse[width]).tolist():
                if row[i] != row[i + width - 1]:
                    continue
                raw = padded.tobytes() if raw is None else raw
                text = b" ".join(raw[starts[k] : ends[k]] for k in range(i, i + width))
                if names := self.known.having(width, h[i], text):
                    hits.setdefault(int(row[i]), []).append((i, i + width))
                    items.setdefault(int(row[i]), set()).update(names)
        for r in range(n):
            first, begin = int(firsts[r]), int(begins[r])
            found = [(s - first, e - first, int(starts[s]) - begin, int(ends[e - 1]) - begin) for s, e in hits.get(r, ())]
            yield int(firsts[r + 1]) - first, merged(found), items.get(r, set())


def merged(ranges) -> list[tuple[int, int, int, int]]:
    """Hits (first, past last word, first, past last byte) in order, those that meet or overlap as one."""
    out: list[tuple[int, int, int, int]] = []
    for s, e, begin, end in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2], max(out[-1][3], end))
        else:
            out.append((s, e, begin, end))
    return out


def without_ranges(text: str, ranges) -> str:
    """``text`` without the merged hits."""
    raw, kept, at = text.encode("utf-8", "replace"), [], 0
    for _, _, begin, end in ranges:
        kept.append(raw[at:begin])
        at = end
    return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")


_RANGES = "array<struct<first: long, past: long, begin: long, end: long>>"
_FOUND = f"struct<n_words: long, n_hit: long, ranges: {_RANGES}, items: array<string>, rest: string>"
_RANGE_TYPE = pa.list_(pa.struct([(f, pa.int64()) for f in ("first", "past", "begin", "end")]))


def _finder(known, cut: bool):
    """The hits of one set in texts, merged with those that ``before`` holds; with ``cut``, also what is left of a text with hits."""

    def find(texts: pa.Array, before: pa.Array) -> pa.Array:
        scanner, cols = Scanner(known.value), ([], [], [], [], [])
        values = texts.to_pylist() if cut else None
        for i, ((words, ranges, items), had) in enumerate(zip(scanner.rows(texts), before.to_pylist())):
            for old in had or ():
                ranges += [(x["first"], x["past"], x["begin"], x["end"]) for x in old["ranges"]]
                items = items | set(old["items"])
            ranges = merged(ranges)
            each = (words, sum(e - s for s, e, *_ in ranges), [dict(zip(("first", "past", "begin", "end"), x)) for x in ranges], sorted(items), without_ranges(values[i], ranges) if cut and ranges else None)
            for c, x in zip(cols, each):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), _RANGE_TYPE, pa.list_(pa.string()), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["n_words", "n_hit", "ranges", "items", "rest"])

    return F.arrow_udf(find, _FOUND)


def with_hits(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, cut: bool = False, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, ranges (of hit words and their bytes), items (sorted as strings), rest (with ``cut``: a hit text without its hits)."""
    spark = docs.sparkSession
    small_batches(spark)
    cols = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    total = cols.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    sets = max(1, -(-int(total) * SET_SHARE // set_bytes))

    def shared(k: int):
        part = cols if sets == 1 else cols.where(F.pmod(F.xxhash64("text"), F.lit(sets)) == k)
        return spark.sparkContext.broadcast(window_set([(r["item"], r["text"]) for r in part.collect()], width))

    none = F.lit(None).cast(f"array<struct<ranges: {_RANGES}, items: array<string>>>")
    if sets == 1:
        return docs.withColumn(out, _finder(shared(0), cut)(F.col(text_col), none))
    # Hits depend on the text alone: each set but the last leaves a table of the hit texts, by their digest, and is let go.
    hits = []
    for k in range(sets - 1):
        known = shared(k)
        found = docs.select(F.md5(text_col).alias("__key"), _finder(known, False)(F.col(text_col), none).alias("f")).where("f.n_hit > 0")
        hits.append(stored(found.select("__key", "f.ranges", "f.items").dropDuplicates(["__key"]), "hits"))
        known.destroy()
    before = reduce(DataFrame.unionByName, hits).groupBy("__key").agg(F.collect_list(F.struct("ranges", "items")).alias("__before"))
    joined = docs.withColumn("__key", F.md5(text_col)).join(before, "__key", "left")
    return joined.withColumn(out, _finder(shared(sets - 1), cut)(F.col(text_col), F.col("__before"))).drop("__key", "__before")


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, ranges (of hit words and their bytes), items (sorted as strings)."""
    found = with_hits(docs.select(id_col, text_col), benchmark, "__found", text_col, item_col, item_text_col, width, set_bytes=set_bytes)
    return found.select(id_col, *(f"__found.{c}" for c in ("n_words", "n_hit", "ranges", "items")))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, most_share: float = 0.5, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` with the hit passages cut out of the texts; documents of which they are over ``most_share`` of the words go."""
    found = with_hits(docs, benchmark, "__found", text_col, item_col, item_text_col, width, True, set_bytes)
    kept = found.where(F.col("__found.n_hit") <= most_share * F.col("__found.n_words"))
    return kept.withColumn(text_col, F.coalesce("__found.rest", text_col)).drop("__found")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = scan_benchmark(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
bw as (select item_id, w, least({WIDTH}, len(w)) as n, unnest(range(1, len(w) - least({WIDTH}, len(w)) + 2)) as i from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as t from bw),
dw as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n),
hit as (select distinct doc_id, i, dw.n, item_id from dw join win on dw.n = win.n and array_to_string(w[i:i + dw.n - 1], ' ') = t),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover on d.doc_id = cover.doc_id left join found on d.doc_id = found.doc_id
"""
