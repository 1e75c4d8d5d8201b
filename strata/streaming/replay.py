"""Tables replayed as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.streaming.fold import announced_fold


def replayed_user_fold(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Streams the events' values, and each user's number of events as an announcement, through the announced fold."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    data = events.select("user_id", F.round(F.col("value") * 100).cast("double").alias("value"), F.lit(None).cast("long").alias("announced"))
    said = events.groupBy("user_id").agg(F.lit(None).cast("double").alias("value"), F.count(F.lit(1)).alias("announced"))
    data.write.mode("append").parquet(f"{folder}/in")
    said.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("user_id long, value double, announced long").option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    query = announced_fold(stream, ["user_id"]).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id long, total double, number long").parquet(f"{folder}/out")
