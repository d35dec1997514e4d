"""A training-corpus pipeline: five stages, each written and read again as the next one's input.

Documents need doc_id and text; other columns, whatever their names, pass through unchanged until
the last stage. Null texts go in the first stage. The later stages, each called on its own, count
them as empty: near-duplicates of nothing, without test phrases, secrets or words to mix, and their
text stays null. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymetrics.llm import language, leaks, mixing, near_dup, secrets
from quaymetrics.llm import text as tx
from quaymetrics.session import stored

#: Share of the best language below which a document is rejected.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; texts without letters and unsure ones go."""
    return language.keep_known(docs, SURE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates.

    Rows that share an id and a text are one document. Of different texts with one id, the one with
    the least hash has the id, and the others stand behind all documents with an id of their own.
    Rows without an id stay.
    """
    key, least = (tx.free_name(n, docs.columns) for n in ("key", "least"))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = (
        docs.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(own).alias(least), F.max(own).alias(key))
        .where(F.col(least) != F.col(key))
        .drop(key)
    )
    told = F.col(least).isNull() | (own == F.col(least))
    other = F.pmod(own, F.lit(1 << 61)) + (1 << 61)
    keyed = docs.join(shared, "doc_id", "left").withColumn(
        key, F.when(told, F.col("doc_id").cast("long")).otherwise(other)
    )
    keyed = keyed.select(key, *docs.columns)
    ids = near_dup.link(keyed.select(F.col(key).alias("doc_id"), "text")).where("kept")
    kept = ids.select(F.col("doc_id").alias(key)).distinct()
    named = keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test phrase occurs."""
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed blocks of text, one row per slot of an output shard."""
    return mixing.Mix(docs).texts()


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]
#: Language, sketches and permutations have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
