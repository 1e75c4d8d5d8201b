import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import langid as li
from strata.llm import quality as q
from strata.llm import toxicity as tx


def held(i, parts, fold):
    return zlib.crc32(str(i).encode()) % parts == fold


@pytest.fixture(scope="module")
def tables(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def auc(pairs):
    up, down = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = q.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    pairs = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert auc(pairs) > 0.9


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = tx.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    pairs = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert auc(pairs) > 0.8  # a few dozen toxic texts to learn from, in four languages


def test_language_on_held_out_documents(tables):
    docs, _ = tables
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in li.score_language(docs).collect() if r.held_out]
    assert all(held(r.doc_id, 4, 2) for r in rows) and sum(r.lang_pred == known[r.doc_id] for r in rows) > 0.97 * len(rows)


def test_held_out_labels_are_never_read(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (q.train_quality(docs, x, keep=F.crc32(F.col("doc_id").cast("string")) % 5 != 0) for x in (labels, turned))
    assert a == b


def test_odd_texts_and_tables(spark, docs, no_docs, tables):
    real, labels = tables
    for fn in (q.score_quality, tx.score_toxicity):
        assert fn(no_docs, labels).count() == 0
        assert fn(docs, labels.where("false")).count() == docs.count()
        extra = labels.selectExpr("doc_id", "quality", "toxic", "'x' as text", "1 as score")
        odd = [r for r in fn(docs.select("doc_id", "text", "id"), extra.unionByName(extra)).collect() if r.doc_id in (10_000, 10_001)]
        assert len(odd) == 2 and odd[0].score == odd[1].score
    assert li.score_language(no_docs).count() == 0
    got = {r.doc_id: r for r in li.score_language(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (10_000, 10_001, 10_002, 10_003, 10_007))
    assert got[10_004].lang_pred == "en"
    null = spark.createDataFrame([(None, "some words here", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert [r.held_out for r in li.score_language(null).collect()] == [False, False]


def segments(scores):
    """All maximal scoring segments by their definition: the best, then what is left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    return [*segments(scores[:i]), (i, j, best), *((a + j + 1, b + j + 1, s) for a, b, s in segments(scores[j + 1 :]))]


def test_maximal_segments():
    r = random.Random(4)
    for _ in range(300):
        background = -0.37
        scores = [background if r.random() < 0.5 else round(r.uniform(-3, 4), 3) for _ in range(r.randint(0, 25))]
        at = [i for i, s in enumerate(scores) if s != background]
        got = sorted(tx.maximal_segments(at, [scores[i] for i in at], background))
        want = sorted(segments(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], scores
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_passages(spark):
    sample = [(f"plain w{i} stand x{i} here y{i} z{i} there words", 0) for i in range(200)] + [(f"plain w{i} nasty x{i} stand here y{i} foul z{i} there", 1) for i in range(60)]
    model = tx.fit_toxicity(sample)
    text = "plain words " * 100 + "nasty foul nasty " + "plain words " * 100
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain words")], "doc_id long, text string")
    found = tx.toxic_passages(df, model).collect()
    assert [(r.doc_id, r.first_word, r.last_word) for r in found] == [(1, 200, 202)]


def test_codewords_and_margins():
    for k in (2, 3, 7, 8, 12):
        c = li.codewords(k)
        assert len({tuple(x) for x in c}) == k and all(len(set(c[:, b])) == 2 for b in range(c.shape[1]))
    model = li.fit_language([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr")])
    long = "the dog and the cat " * 120_000  # over a block
    m = li.margins_of(model, pa.array([long, "the dog and the cat " * 50, "", None]))
    assert m[0] == pytest.approx(m[1], abs=1e-2) and not m[2:].any()
    best, share, lead = li.decode(model, m[:2])
    assert [model.languages[b] for b in best] == ["en", "en"] and np.all(share > 0.34) and np.all(lead > 0)
    one = li.fit_language([("a b", "en")])
    assert li.decode(one, li.margins_of(one, pa.array(["x"])))[0].tolist() == [0]


def plain_margins(model, text):
    """n-gram by n-gram, over one text."""
    raw = text.encode().lower()
    folded = bytes(32 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in raw) + bytes(3)
    total = np.zeros(model.weights.shape[1])
    for i in range(len(raw)):
        for order, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77), (4, 0xC2B2AE3D)):
            slot = ((int.from_bytes(folded[i : i + order], "big") + order) * factor & 0xFFFFFFFF) >> 16
            total += model.weights[slot]
    return total / max(1, 3 * len(raw))


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark):
    model = li.fit_language([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr"), ("los gatos y que perro", "es")])
    texts = ["der", "zzz", "le chat", "que los", "a", "éé", "the dog and", "", "DER Hund!", "x" * 50] * 3
    whole = li.margins_of(model, pa.array(texts))
    for i, t in enumerate(texts):
        assert np.array_equal(whole[i], li.margins_of(model, pa.array([t]))[0])
        assert whole[i] == pytest.approx(plain_margins(model, t), abs=1e-5)
    df = spark.createDataFrame(list(enumerate(["der", "zzz", "der", "que los", "der"])), "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r.language for r in li.with_language(df, model).collect()}
    assert rows[0] == rows[2] == rows[4] and rows[0].lang == "de"


def test_ambiguous_texts_are_flagged(spark):
    model = li.fit_language([("aaaa bbbb " * 30, "x"), ("cccc dddd " * 30, "y")])
    df = spark.createDataFrame([(1, "aaaa bbbb aaaa"), (2, "aaaa cccc aaaa cccc"), (3, "zq")], "doc_id long, text string")
    got = {r.doc_id: r.language for r in li.with_language(df, model).collect()}
    assert got[1].lang == "x" and not got[1].ambiguous and got[2].ambiguous and got[3].ambiguous


def test_every_labelled_language_is_learned(spark):
    rows = [(i, "le chien et le chat " * 20, "fr") for i in range(50)] + [(100, "der hund und die katze " * 2000, "de"), (101, None, "xx"), (102, "", "yy"), (103, "mots", None)]
    model = li.train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "fr"]


def test_toxicity_score_plainly():
    """Segments by their definition, expected numbers, and the calibration, word by word."""
    sample = [(f"plain w{i} stand x{i} here y{i} z{i} there words", 0) for i in range(200)] + [(f"plain w{i} nasty x{i} stand here y{i} foul z{i} there", 1) for i in range(60)]
    model = tx.fit_toxicity(sample)
    for text in ("plain words " * 30 + "nasty foul nasty, " + "plain words " * 5 + "Foul!", "nasty", "plain", "", "here there nasty " * 20):
        tokens = text.split()
        found = [model.factor * len(tokens) * np.exp(-model.decay * s) for *_, s in segments([model.token_weight(t) for t in tokens])]
        bits = [-np.log(e) for e in found if e <= tx.MOST_EXPECTED]
        w = model.weights
        want = 1 / (1 + np.exp(-(w[0] + w[1] * np.log1p(max(bits, default=0)) + w[2] * np.log1p(sum(bits)))))
        score, n, _ = tx.toxicity_of(model, text)
        assert score == pytest.approx(want, abs=1e-9) and n == len(bits)
    assert tx.toxicity_of(model, "plain nasty foul there")[0] > tx.toxicity_of(model, "plain there")[0] == tx.toxicity_of(model, None)[0]


def test_quality_score_plainly():
    import zstandard

    sample = [(f"a sound sentence number {i} about rivers and old towns {i * 7}", 1) for i in range(40)] + [(f"buy now {i} click click click $$$ {i * 3}", 0) for i in range(12)] + [("", 0)] * 3
    model = q.fit_quality(sample)
    assert model.empty < 0.3
    texts = ["a sound sentence number 99 about rivers and old towns 693", "buy now 77 click click click $$$ 231", "x", None, ""]
    got = q.quality_of(model, texts)
    for t, score in zip(texts[:3], got):
        raw, sizes = t.encode(), []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=q.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[i : i + q.BLOCK])) for i in range(0, len(raw), q.BLOCK)))
        d, r = (sizes[1] - sizes[0]) / sum(sizes), np.log(min(sizes) / len(raw))
        z = (np.array([d, r, r * r, d * r, d * d]) - model.centre) / model.scale
        assert score == pytest.approx(1 / (1 + np.exp(-(model.weights[0] + z @ np.array(model.weights[1:])))), abs=1e-6)
    assert got[0] > 0.5 > got[1] and got[3] == got[4] == model.empty


def test_both_labels_weigh_alike():
    from strata.llm.common import logistic

    x, y = np.array([[0.0], [1.0], [0.0], [1.0]]), np.array([0, 0, 1, 1.0])
    many = logistic(np.vstack([x, np.repeat(x[2:], 50, axis=0)]), np.append(y, np.ones(100)), ridge=0.0)
    assert many == pytest.approx(logistic(x, y, ridge=0.0), abs=1e-4)
