"""A corpus pipeline: quality, near duplicates, benchmark decontamination, personal data, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, packing, pii, quality, simhash_bk
from strata.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents stay whose quality score reaches this.
LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_quality(docs, model, out="__quality").where(F.col("__quality") >= LEAST_QUALITY).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: its smallest doc_id."""
    return simhash_bk.without_copies(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their benchmark passages; documents that are mostly such passages go."""
    cleaned = decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document that is left, in sequences of at most 2048 tokens."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``; each stage's result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    return reduce(lambda d, s: s[1][1](spark, d, sf_dir) if s[0] == last else stored(s[1][1](spark, d, sf_dir), s[1][0]), enumerate(STAGES), docs)


ORACLE_SQL = None
