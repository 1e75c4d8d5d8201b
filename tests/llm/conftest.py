import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"

PASSAGE = "One two three four five six seven eight nine ten eleven TWELVE"


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text) with every odd case, and real texts."""
    real = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    odd = [
        None, "", " ", "\n\t", "a", "A b", "a b c", "...", "é", "日本 語", "x" * 3000, "w " * 9000, "Mail a@b.co, b@c.d.e and +1 (555) 123-4567.",
        "Card 4111 1111 1111 1111 or 4111-1111-1111-1112; ip 1.2.3.4, 1.2.3.256 and 001.002.003.004", "a@b.c+d@e.f.g @x.y a@b", "+123 +1234567890123456 +1 234 567 890 .",
        "1.2.3.4.5.6.7.8 9.9.9.9.9", "\U0001f600 x@y.zz \U0001f600 10.0.0.1", "1 2-3 4" * 10, "  two  spaces \n and \t tabs  ", PASSAGE, "x " + PASSAGE.lower() + " y", PASSAGE.replace(" ", ", "),
    ]
    out = [(r["doc_id"], r["text"]) for r in real] + [(10_000 + i, t) for i, t in enumerate(odd)]
    return out + [(20_000, PASSAGE), (20_001, PASSAGE)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With a column that clashes with names the operators use inside."""
    df = spark.createDataFrame([(i, t, "x", i, "en") for i, t in rows], "doc_id long, text string, id string, score long, lang string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def small():
    return SMALL
