import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import StrataError
from strata.graph import Graph
from strata.names import LayerPath, Selector
from strata.sources import LayerGenerator, ProductStore, SourceDriver, StoredSource


@pytest.fixture
def stored(spark, tmp_path):
    store = ProductStore(spark, f"file://{tmp_path}/store", compression="snappy")
    g = Graph(spark, LayerGenerator().add_layer("event", count=4).add_layer("segment", "event", 15))
    g.provide("make", lambda c: c.number, creator="tracks", suffix="number", layer="segment")
    g.transform("points", lambda n: (F.array_repeat(n, 2), F.array(F.struct(n.alias("x"), (n + 1).alias("y")))), inputs=[Selector("segment", "tracks", "number")], outputs=["hits", "points"])
    g.fold("joined", F.collect_list, inputs=[Selector("segment", "tracks", "number")], partition="event", initial=[])
    g.output("save", store.sink)
    g.execute()
    return store


def test_round_trip(stored):
    assert stored.paths("points") == [LayerPath("event/segment")]
    rows = stored.read("points").collect()
    assert len(rows) == 60 and all(r.hits == [r.k_segment] * 2 and r.points[0].y == r.k_segment + 1 for r in rows)
    only = stored.read("points", ["hits"])
    assert only.columns == ["k_event", "k_segment", "cell_id", "hits"]
    assert {len(r.value) for r in stored.read("joined").collect()} == {15}
    assert stored.indices("joined").first().cell_id == "[event:0]"
    with pytest.raises(StrataError, match="No product 'points/none'"):
        stored.read("points", ["none"])
    with pytest.raises(StrataError, match="0 stored layer paths"):
        stored.read("nobody")


def test_rows_are_found_by_their_index_as_written(stored):
    for text in ("[event:1, segment:2]", "[Segment=2; event=1]"):
        r = stored.row_of("points", text).first()
        assert (r.k_event, r.k_segment) == (1, 2)
    assert stored.token("points", "hits", "[event:1, segment:2]").row == 17
    for bad in ("[event:9, segment:2]", "[event:1]", "[run:1, segment:2]"):
        with pytest.raises(StrataError, match="No stored cell"):
            stored.row_of("points", bad)
    with pytest.raises(ValueError):
        stored.row_of("points", "event:1")


def test_structures_may_gain_fields(stored):
    wider = T.StructType([T.StructField("k_event", T.LongType()), T.StructField("k_segment", T.LongType()), T.StructField("cell_id", T.StringType()), T.StructField("points", T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("index", T.IntegerType())])))])
    assert {r.points[0]["index"] for r in stored.read("points", ["points"], schema=wider).collect()} == {None}


def test_stored_products_feed_another_graph(spark, stored):
    source = StoredSource(stored, "points")
    g = Graph(spark)
    s = g.source("file", source.create_providers, source.indices)
    g.add_driver(SourceDriver([s]))
    g.transform("size", lambda h: F.size(h), inputs=[Selector("segment", "points", "hits")])
    run = g.execute()
    assert run.execution_count("size") == 60 and run.seen_cell_count("segment") == 60


def test_backends_and_attributes(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    for bad, message in ((dict(technology="hdf5"), "not yet implemented"), (dict(technology="tape"), "Unknown storage technology"), (dict(level="9"), "Unknown storage attribute")):
        with pytest.raises(StrataError, match=message):
            ProductStore(spark, at, **bad)
    df = spark.range(3).select(F.col("id").alias("k_event"), F.col("id").alias("value"), F.col("id").alias("other"))
    for technology in ("parquet", "orc"):
        store = ProductStore(spark, f"{at}-{technology}", technology, ["value", "c/other"], compression="odd")
        store.write("c", LayerPath("event"), df)
        assert store.read("c").count() == 3
        with pytest.raises(StrataError, match="No configuration for product 'd/other'"):
            store.write("d", LayerPath("event"), df)
    none = ProductStore(spark, at, "noop")
    none.write("c", LayerPath("event"), df)
    assert none.paths("c") == []
    store.write("empty", LayerPath("event"), df.select("k_event"))
    assert store.paths("empty") == []
