"""The corpus pipeline: language ID, near-duplicate removal, repeated passages, test items, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again as the docs
of the next. All but the last return the columns of ``documents``; the last adds ``mix_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrid.llm import decontaminate, language, mixing, ngram_join, suffix
from claimgrid.llm.tables import crc_part, ready, table, written

LEAST_SCORE = 0.5
SHINGLE_WORDS, LEAST_PERCENT = 5, 80
LEAST_MATCH_WORDS = 3


def with_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of at least LEAST_SCORE. The trees learn from the stage's own
    input. Texts that are null or have no letter go."""
    ready(spark)
    learned = language.train(docs.filter(crc_part(5) != 0))
    return language.identify(docs, learned).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 80 per cent, the one with the smallest doc_id stays."""
    ready(spark)
    return ngram_join.representatives(docs, SHINGLE_WORDS, LEAST_PERCENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that stand more than once are taken out; a document without a word left goes."""
    ready(spark)
    cut = suffix.deduped(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go. A match of fewer than LEAST_MATCH_WORDS words
    is no copy: items of one or two words stand in ordinary text too."""
    copies = F.exists("matches", lambda m: m["last_word"] - m["first_word"] + 1 >= LEAST_MATCH_WORDS)
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).filter(~copies).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens left, shared out by domain, language and source."""
    ready(spark)
    return mixing.production(docs)


STAGES = [
    ("language_id", with_known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_test_items),
    ("source_mixing", mixture),
]

#: SQL can't express the language model of the first stage nor the alignment of the fourth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
