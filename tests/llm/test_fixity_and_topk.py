import random

import pytest
from pyspark.sql import functions as F

from strata.llm import fixity as fx
from strata.llm import hamming_topk as ht


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_finds_each_damage(spark):
    rows = [(i, f"u{i}", "h" * (i % 50)) for i in range(0, 3000, 3)] + [(9, "twice", "x"), (None, "lost", "y"), (4, None, None)]
    mine = pages(spark, rows)
    other = [r for r in rows if r[0] not in (300, 2997)]
    other = [(i, u, "changed" if i == 1500 else h) for i, u, h in other] + [(70_001, "new", "z")]
    got = {(r.position, r.status) for r in fx.audit(mine, pages(spark, other), levels=3, fanout=8).collect()}
    assert {x for x in got if x[1] != "intact"} == {(300, "missing"), (2997, "missing"), (1500, "altered"), (70_001, "added")}
    assert len({p for p, _ in got}) == 1002
    assert {r.status for r in fx.audit(mine, mine).collect()} == {"intact"}


def test_offsets_are_running_totals(spark):
    df = pages(spark, [(i, "u", "é" * (i % 7)) for i in range(500)])
    recs = fx.records(df)
    got = fx.with_offsets(recs, span=16).orderBy("position").collect()
    at = 0
    for r in got:
        assert r.offset == at
        at += r.length


def test_roots_agree_only_if_all_agrees(spark):
    df = fx.records(pages(spark, [(i, "u", str(i)) for i in range(100)]))
    top = fx.trees(df, df, 2, 16)[-1].collect()
    assert len(top) == 1 and top[0].hash == top[0].other_hash
    top = fx.trees(df, df.where("position <> 57"), 2, 16)[-1].collect()
    assert top[0].hash != top[0].other_hash


def test_large_and_sparse_positions_have_one_root(spark):
    rows = [(i * 7_919_000_000 + 3, "u", str(i)) for i in range(40)]
    df = pages(spark, rows)
    top = fx.trees(fx.records(df), fx.records(df))[-1].collect()
    assert len(top) == 1 and top[0].node == 0
    other = pages(spark, [(i, u, "x" if h == "17" else h) for i, u, h in rows])
    got = [(r.position, r.status) for r in fx.audit(df, other).orderBy("position").collect()]
    assert [s for _, s in got] == ["altered" if i == 17 else "intact" for i in range(40)]


def test_empty_archives(spark):
    df = pages(spark, [(1, "u", "h")])
    none = df.where("false")
    assert fx.audit(none, none).count() == 0
    assert [r.status for r in fx.audit(df, none).collect()] == ["missing"] and [r.status for r in fx.audit(none, df).collect()] == ["added"]


def brute(rows, asked, k):
    out = set()
    for q, c in asked:
        near = sorted(((c ^ d) & (1 << 64) - 1).bit_count() * 10**9 + i for i, d in rows if i != q)[:k]
        out |= {(q, x % 10**9, x // 10**9, n + 1) for n, x in enumerate(near)}
    return out


def test_top_k_is_exact_with_ties_copies_and_blocks(spark):
    r = random.Random(2)
    codes = [r.getrandbits(64) - (1 << 63) for _ in range(40)]
    rows = []
    for i in range(1200):
        c = r.choice(codes)
        for _ in range(r.choice((0, 0, 0, 1, 2, 5, 9))):
            c ^= 1 << r.randrange(63)
        rows.append((i, c))
    asked = [x for x in rows if x[0] % 20 == 0]
    df, q = (spark.createDataFrame(x, "id long, code long") for x in (rows + [(5000, None)], asked + [(5001, None)]))
    for shard, segments in ((1 << 14, None), (40, 5)):  # one shard a segment; several; crowded ones in chunks
        got = [tuple(x) for x in ht.top_k(df, q, 7, shard=shard, segments=segments).collect()]
        assert set(got) == brute(rows, asked, 7) and len(got) == 7 * len(asked)
    twice = spark.createDataFrame(rows + rows[:50] * 3, "id long, code long")
    assert {tuple(x) for x in ht.top_k(twice, q, 7).collect()} == brute(rows, asked, 7)
    few = spark.createDataFrame([(1, 0), (2, 3)], "id long, code long")
    assert {tuple(x) for x in ht.top_k(few, few, 5).collect()} == {(1, 2, 2, 1), (2, 1, 2, 1)}
    assert ht.top_k(df.where("false"), q, 5).count() == 0 and ht.top_k(df, q.where("false"), 5).count() == 0


def test_large_index_answers_from_its_tables(spark, monkeypatch):
    """20,000 codes through ``top_k``: exact, and the codes that the tables give are a small part of all."""
    import numpy as np

    g = np.random.default_rng(1)
    codes = g.integers(-(1 << 63), 1 << 63, 20_000).tolist()
    for i in range(0, 20_000, 500):  # a group around each query
        for n in range(1, 13):
            codes[i + n] = codes[i] ^ sum(1 << int(b) for b in g.choice(63, n % 6, replace=False))
    rows = list(enumerate(codes))
    asked = rows[::500]
    df, q = (spark.createDataFrame(x, "id long, code long") for x in (rows, asked))
    got = {tuple(x) for x in ht.top_k(df, q, 10, shard=1 << 10).collect()}
    assert got == brute(rows, asked, 10)
    split = ht.Segments(20_000)
    assert len(split) == 4 and split.covered(1) == 7
    index = ht.Shard(split, 0, np.array(codes, np.int64).view(np.uint64))
    met = sum(len(index.met(np.int64(c).astype(np.uint64), 0, s)) for _, c in asked for s in (0, 1))
    assert met < 20_000 * len(asked) / 100


def test_probes_cover_every_distance():
    import numpy as np

    g = np.random.default_rng(3)
    for m, shard in ((4, 4), (5, 64), (7, 1 << 14)):
        split = ht.Segments(4096, shard, m)
        query = g.integers(0, 1 << 63, dtype=np.uint64)
        for d in range(0, 12):
            code = query
            for b in g.choice(64, d, replace=False):
                code ^= np.uint64(1) << np.uint64(b)
            radius = min(s for s in range(65) if split.covered(s) >= d)
            found = [j for j in range(m) for s in range(radius + 1) if len(ht.Shard(split, j, np.array([code])).met(query, int(split.lead(code, j)), s))]
            assert found


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [1.0] + [-1.0] * 62 + [2.0]), (2, None), (3, [0.0, 3.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.code for r in df.select("vec_id", ht.sign_code("embedding").alias("code")).collect()}
    assert got == {1: 1 - (1 << 63), 2: None, 3: 2}
    assert df.select(F.lit(1)).count() == 3
    with pytest.raises(Exception, match="64 elements"):
        spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>").select(ht.sign_code("embedding")).collect()
