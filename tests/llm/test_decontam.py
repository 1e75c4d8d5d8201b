import hashlib
import re

from pyspark.sql import functions as F

from strata.llm import decontam as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(rows, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= s
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def items(spark, small):
    own = spark.createDataFrame([(900, "one two three four five six seven eight nine ten eleven"), (901, None), (902, ""), (903, "日本"), (904, "a B"), (905, "a b")], "item_id long, text string")
    return spark.read.parquet(f"{small}/benchmark.parquet").unionByName(own)


def test_matches_a_plain_scan(spark, docs, rows, small):
    bench = items(spark, small)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.contamination(docs, bench).collect()}
    want = plain(rows, [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert got == want and sum(v[4] for v in want.values()) > 3


def test_several_sets_give_the_same(spark, docs, small):
    bench = items(spark, small)
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] * dc.SET_SHARE
    one = dc.scan_benchmark(docs, bench).orderBy("doc_id").collect()
    many = dc.scan_benchmark(docs, bench, set_bytes=size // 3).orderBy("doc_id").collect()
    assert one == many and sum(r.n_hit for r in one) > 100
    clean = [sorted(map(tuple, dc.without_benchmark(docs, bench, set_bytes=n).collect())) for n in (1 << 28, size // 3)]
    assert clean[0] == clean[1]


def test_overlapping_items_are_cut_once(spark):
    """Two items that overlap in a text, in sets of their own: neither cut hides the other's window, and the share is of the whole text."""
    a = [f"a{i}" for i in range(12)]
    b = [*a[6:], *(f"b{i}" for i in range(8))]
    text = " ".join(["go"] * 30 + a + b[6:] + ["on"] * 30)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string")
    for bytes_ in (1 << 28, 200, 20):
        got = dc.without_benchmark(df, bench, set_bytes=bytes_).first().text
        assert got.split() == ["go"] * 30 + ["on"] * 30
        assert dc.without_benchmark(df, bench, most_share=0.2, set_bytes=bytes_).count() == 0


def test_empty_tables_and_cleaning(spark, docs, no_docs, small):
    bench = items(spark, small)
    assert dc.contamination(no_docs, bench).count() == 0
    assert dc.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    clean = dc.without_benchmark(docs, bench)
    assert clean.columns == docs.columns and clean.count() < docs.count()
    assert clean.where(F.col("doc_id").isin(20_000, 20_001)).count() == 0
    text = "start here " * 20 + "one two three four five six seven eight nine ten eleven" + " end there" * 20
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert dc.without_benchmark(df, bench).first().text == "start here " * 20 + " end there" * 20


def test_long_words_hash_like_short_ones():
    import numpy as np

    raw = b"abc " + b"y" * 100 + b" abc " + b"y" * 100 + b" " + b"y" * 99 + b"z"
    data = np.frombuffer(raw, np.uint8)
    h = dc.word_hashes(data, *dc.word_bounds(data))
    assert h[0] == h[2] and h[1] == h[3] and h[1] != h[4]
    short = np.frombuffer(b"abc", np.uint8)
    assert dc.word_hashes(short, *dc.word_bounds(short))[0] == h[0]
