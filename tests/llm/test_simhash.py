import random
from itertools import combinations

import xxhash

from strata.llm import simhash_bk as sh


def plain(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, radius=3):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in combinations(up, 2):
        if (a ^ b).bit_count() <= radius:
            up[find(a)] = find(b)
    return {v: find(v) for v in up}


def test_fingerprints_and_components(docs, rows):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in sh.near_duplicate_classes(docs).collect()}
    fps = {i: plain(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == fps
    roots = classes(fps.values())
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {i: c for i, (_, c) in got.items()} == {i: least[roots[f]] for i, f in fps.items()}


def clustered(n, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(n // 40)] + [0, (1 << 64) - 1]
    out = set()
    for _ in range(n):
        v = r.choice(centres)
        for _ in range(r.randint(0, 7)):
            v ^= 1 << r.randrange(64)
        out.add(v)
    return sorted(out)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_connect_what_brute_force_connects(spark):
    values = clustered(1500, 5)
    want = classes(values)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for limit, blocks in ((4096, None), (30, None), (4096, 5), (25, 6)):
        links = sh.fingerprint_links(df, 3, limit, blocks)
        got = {r.node & (1 << 64) - 1: r.root for r in sh.components(links).collect()}
        seen, other = {}, {}
        for v in values:
            a, b = want[v], got.get(v, signed(v))
            assert seen.setdefault(a, b) == b and other.setdefault(b, a) == a


def test_tree_finds_all_and_only_neighbours():
    values = clustered(600, 9)
    tree, before = sh.LinkedTree(), []
    for v in values:
        assert {x for x in tree.add(v)} <= {x for x in before if (x ^ v).bit_count() <= 3}
        before.append(v)
    roots = {v: tree.find(i) for i, v in enumerate(values)}
    want = classes(values)
    assert len(set(roots.values())) == len(set(want.values()))


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {(r.root) for r in sh.components(links).collect()} == {0}


def test_copies_with_a_few_changed_words_go(spark):
    import random as rnd

    r = rnd.Random(1)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(5000)]
    rows, n = [], 0
    for base in range(60):
        words = [r.choice(vocabulary) for _ in range(300)]
        rows.append((n, " ".join(words), True))
        for _ in range(base % 3):
            copy = list(words)
            for _ in range(5):
                copy[r.randrange(300)] = r.choice(vocabulary)
            n += 1
            rows.append((n, " ".join(copy), False))
        n += 1
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in sh.without_copies(df).collect()}
    first = {i for i, _, own in rows if own}
    assert first <= kept and len(kept - first) <= 2


def test_no_documents_and_copies(spark, docs, no_docs, rows):
    assert sh.near_duplicate_classes(no_docs).count() == 0
    kept = sh.without_copies(docs)
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and set(ids) <= {r.component_id for r in sh.near_duplicate_classes(docs).where("doc_id < 10000").collect()} | set(range(10_000, 20_002))
    twice = docs.unionByName(docs)
    assert sorted(r.doc_id for r in sh.without_copies(twice).collect()) == ids
    null = spark.createDataFrame([(None, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in sh.near_duplicate_classes(null).collect()) == [(False, 3), (True, 3)]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.split(), b.split()))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_fingerprints_alone_remove_nothing(spark):
    r = random.Random(3)
    words = [f"w{r.getrandbits(40)}" for _ in range(60)]
    shuffled = [" ".join(r.sample(words, 60)) for _ in range(5)]  # one fingerprint, no shingle in common
    copy = " ".join([*shuffled[0].split(), "end"])
    texts = [*shuffled, copy, shuffled[1]]
    assert (sh.fingerprints_of(texts[:1], distinct=True) == sh.fingerprints_of(shuffled, distinct=True)).all()
    assert jaccard(shuffled[0], copy) >= 0.8 > max(jaccard(a, b) for a, b in combinations(shuffled, 2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in sh.without_copies(df).collect()) == [0, 1, 2, 3, 4]


def test_candidates_are_all_pairs_of_a_shard_between_groups(spark):
    values = clustered(500, 4)
    # groups of all sizes: one holds half of all nodes; two slots of keys, one very common
    rows = [(signed(v), 10 * i + k, (10 * i + k) % 7 if i % 2 else -1, 10 + i % 4, [i % 3 and i % 40, i % 11], [5, 6 + i % 2], b"") for i, v in enumerate(values) for k in range(1 + (i % 9 == 0))]

    def near(a, b):
        return ((a[0] ^ b[0]) & (1 << 64) - 1).bit_count() <= 8 and a[2] != b[2] and 5 * min(a[3], b[3]) >= 4 * max(a[3], b[3]) and any(x == y for x, y in zip(a[4], b[4]))

    want = {(max(a[1], b[1]), min(a[1], b[1])) for a, b in combinations(rows, 2) if near(a, b)}
    df = spark.createDataFrame(rows, "fp long, node long, group long, size int, keys array<long>, more_keys array<long>, mark binary")
    for limit in (4096, 60, 25):
        assert {(r.a, r.b) for r in sh.candidate_pairs(df, 8, limit).collect()} == want


def test_marks_exclude_no_similar_pair():
    import numpy as np

    g = np.random.default_rng(6)
    refused = 0
    for _ in range(400):
        n = int(g.integers(1, 900))
        x = np.unique(g.integers(0, 1 << 62, n))
        y = np.unique(np.concatenate([g.permutation(x)[: int(len(x) * g.uniform(0.5, 1))], g.integers(0, 1 << 62, int(n * g.uniform(0, 0.3)))]))
        if not len(y):
            continue
        common = len(np.intersect1d(x, y))
        alike = 5 * common >= 4 * (len(x) + len(y) - common)
        a, b = (sh.Marked(0, 0, len(v), sh.mark_of(v)) for v in (x, y))
        assert a.may_equal(b) == b.may_equal(a) and (a.may_equal(b) or not alike)
        refused += not a.may_equal(b)
    assert refused > 100


def test_large_groups_of_copies_cost_no_pairs(spark):
    """Half of all texts are near copies of one, in shards far over the limit: one group, found without its pairs."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        words[r.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{r.getrandbits(30)}" for _ in range(120)) + " " + " ".join(base[:12])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = sh.copies(df, limit=50).collect()
    mine = {x.group for x in groups if x.id < 1000}
    assert len(mine) == 1 and len({x.group for x in groups}) == 101
    assert sorted(x.doc_id for x in sh.without_copies(df).collect()) == [0, *range(1000, 1100)]


def test_copies_equal_an_exact_join(spark, small):
    """Recall and precision against all pairs of the real texts; nothing was chosen on this table."""
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else {()} for i, t in texts.items()}
    having, pairs = {}, set()
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    for ids in having.values():
        pairs |= set(combinations(ids, 2))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {}
    for i in sets:
        want.setdefault(find(i), set()).add(i)
    got = {}
    for x in sh.copies(docs).collect():
        got.setdefault(x.group, set()).add(x.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_repeated_ids_with_other_texts_stay(spark):
    rows = [(1, "one text of its own words", 1), (1, "another that shares nothing with it", 2), (1, "one text of its own words", 3), (2, "another that shares nothing with it", 4), (2, "a third and last one here", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    assert sorted((r.doc_id, r.text, r.n) for r in sh.without_copies(df).collect()) == sorted([rows[0], rows[1], rows[4]])
