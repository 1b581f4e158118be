"""Shared by the operators: row keys, intermediate tables, and settings of the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

import claimgrid.llm

from claimgrid.session import shared_path, tune

LAST_ID = (1 << 63) - 1
WORD_GAP = "[\\x20\\x09-\\x0D]+"
DEAL = "_deal"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS, BATCH_BYTES = 4000, 32 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Adaptive joins that split skewed keys, Arrow batches bounded in rows and bytes, and worker functions that travel
    with their code, so that executors need no copy of the package."""
    tune(spark)
    # a short list of documents filters the texts by a Bloom filter of bounded size before these are shuffled to it
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "16MB")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1GB")
    cloudpickle.register_pickle_by_value(claimgrid.llm)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: the two first name a document. A null doc_id stands after all others, so it is never the
    smaller one. Rows that repeat doc_id and text are one document that is listed twice."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))


def named(docs: DataFrame) -> DataFrame:
    """_id and _key, which name a document as ``keyed`` does, and ``row`` with all columns, whatever their names."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("_id"), F.xxhash64("text").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def plain_id() -> Column:
    """doc_id with the stand-in for null taken back."""
    return F.when(F.col("doc_id") == LAST_ID, None).otherwise(F.col("doc_id")).alias("doc_id")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder. Later steps start from its files, whichever executors are lost. The shuffle
    files of the job that wrote it serve nothing after it, so Spark removes them when it ends."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def grouped(df: DataFrame, *keys: str) -> GroupedData:
    """Like groupBy, but grouped by a hash of the keys besides. A later join on the keys then deals both of its sides
    out anew, and adaptive execution can split a hot key of the other side, which it can't beneath an aggregate."""
    return df.groupBy(*keys, F.xxhash64(*keys).alias(DEAL))


def crc_part(parts: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
