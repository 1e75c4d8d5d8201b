import pytest
from pyspark.sql import functions as F

from strata.errors import StrataError
from strata.streaming import CellTracker, announced_fold, windowed_counts
from strata.streaming.replay import replayed_user_fold


def test_tracker_announces_what_the_walk_leaves():
    t = CellTracker()
    run4, run5 = (("run", 4),), (("run", 5),)
    spill5, spill6 = (*run4, ("spill", 5)), (*run4, ("spill", 6))
    got = [x for c in ((), run4, spill5, spill6, (*spill6, ("subspill", 2)), run5) for x in t.enter(c)] + t.close()
    assert got == [(spill6, {"subspill": 1}), (run4, {"spill": 2}), ((), {"run": 2})]
    t = CellTracker()
    with pytest.raises(StrataError, match="must be the job"):
        t.enter(run4)
    t.enter(())
    with pytest.raises(StrataError, match="skips its parent"):
        t.enter(spill5)
    t.enter(run4)
    with pytest.raises(StrataError, match="skips its parent"):
        t.enter((*run5, ("spill", 1)))


def drain(frame, path, name):
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{path}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name).collect()


def test_announced_fold_takes_any_order(spark, tmp_path):
    rows = [(1, 2.0, None), (2, None, 1), (1, None, 2), (3, None, 0), (1, 3.0, None), (2, 7.0, None), (4, 1.0, None), (5, 1.0, None), (5, None, 1), (5, None, 0)]
    for i, r in enumerate(rows):  # a batch each
        spark.createDataFrame([r], "k long, value double, announced long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, value double, announced long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = sorted(map(tuple, drain(announced_fold(stream, ["k"]), tmp_path, "folded")))
    assert got == [(1, 5.0, 2), (2, 7.0, 1), (3, 0.0, 0), (5, 1.0, 1)]  # 4 is still open


def test_announced_fold_waits_for_all_announcements(spark, tmp_path):
    rows = [(1, 1.0, None), (1, 2.0, None), (1, None, 2), (1, None, 1), (1, 2.0, None), (2, None, 1), (2, 4.0, None)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k long, value double, announced long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, value double, announced long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = sorted(map(tuple, drain(announced_fold(stream, ["k"], announcements=2), tmp_path, "waiting")))
    assert got == [(1, 5.0, 3)]  # 2 waits for another announcement
    with pytest.raises(Exception, match="is closed"):
        drain(announced_fold(stream, ["k"]), tmp_path, "late")


def test_stream_equals_batch(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    got = sorted((r.user_id, r.total, r.number) for r in replayed_user_fold(spark, small, f"file://{tmp_path}/s").collect())
    events = spark.read.parquet(f"{small}/events.parquet")
    want = sorted(map(tuple, events.groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100)), F.count(F.lit(1))).collect()))
    assert got == want


def test_windowed_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
