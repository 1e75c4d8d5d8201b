import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from strata.llm import decontam, pii, quality, simhash_bk


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts, now = [docs.count()], docs
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, small).cache()
        assert now.columns == list(cp.COLUMNS), name
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert decontam.contamination(now, bench).where("contaminated").count() == 0
    found = pii.personal_data(now)
    assert found.where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert simhash_bk.near_duplicate_classes(now).where("doc_id <> component_id").count() <= counts[0] // 20
    packed = cp.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_clean_documents_stay(spark, small):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{small}/labels.parquet").to_pylist()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in cp.good_quality(spark, docs, small).collect()}
    good = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_take_odd_documents(spark, small, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"
    odd = [(None, None, None, None, None, 1.0, 1), (1, "", "en", "s", 0, None, 2), (2, "x y z " * 30_000, "en", "s", 5, 1.0, 3), (3, "plain text", None, None, None, 1.0, 3), (3, "plain text", None, None, None, 1.0, 3)]
    df = spark.createDataFrame(odd, schema)
    assert stage(spark, df, small).count() >= 0
    assert stage(spark, df.where("false"), small).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names and set(e.oracle_sql()) <= set(names)
    assert len(cp.STAGES) == 5 and quality.SAMPLE_PER_LABEL > 0
