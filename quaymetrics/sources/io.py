"""Readers, writers and one-pass table summaries."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymetrics.core import col, hash32
from quaymetrics.operators.trips import ensure_columns
from quaymetrics.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_trips(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, required: Sequence[str]
) -> DataFrame:
    """Parquet scan: required columns must exist, optional ones are null-filled."""
    df = spark.read.parquet(*paths)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    full = ensure_columns(df, schema)
    return full.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_piped(
    spark: SparkSession, path: str, layouts: Mapping[str, T.StructType]
) -> DataFrame:
    """Headerless pipe-delimited text, each file by a layout of its own.

    A file's most common field count names its layout; a count that no layout has is an error.
    The result has the fields of all layouts, null where a file's layout lacks one, and the
    layout's label. Within a file short lines are padded with nulls; `extra_fields` tells how many
    fields of a longer line are beyond the layout.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.split("value", r"\|", -1).alias("_f")
    )
    counts = lines.groupBy("_file", F.size("_f").alias("n")).agg(F.count(F.lit(1)).alias("lines"))
    modal = counts.groupBy("_file").agg(
        F.max_by("n", F.struct("lines", (-F.col("n")).alias("fewest"))).alias("n")
    )
    label = F
    for name, layout in layouts.items():
        label = label.when(F.col("n") == len(layout), F.lit(name))
    named = modal.select("_file", "n", label.alias("layout"))
    unknown = named.where("layout is null").limit(1).collect()
    if unknown:
        raise ValueError(f"no layout has {unknown[0]['n']} fields")
    fields: dict[str, T.DataType] = {}
    for layout in layouts.values():
        fields |= {f.name: f.dataType for f in layout}

    def value(field: str) -> Column:
        out = F
        for name, layout in layouts.items():
            if field in layout.names:
                at = F.try_element_at("_f", F.lit(layout.names.index(field) + 1))
                out = out.when(F.col("layout") == name, F.nullif(F.trim(at), F.lit("")))
        return out.try_cast(fields[field]).alias(field)

    return lines.join(named, "_file").select(
        *[value(f) for f in fields],
        "layout",
        F.greatest(F.size("_f") - F.col("n"), F.lit(0)).alias("extra_fields"),
    )


VINTAGE_PAYLOAD = (
    "series_id string, units string, observations array<struct<"
    "date:string, realtime_start:string, realtime_end:string, release_date:string, value:string>>"
)


def flatten_vintages(df: DataFrame, payload: str) -> DataFrame:
    """Nested series documents to vintage rows; "." and "" are missing values."""
    doc = df.select(F.from_json(payload, VINTAGE_PAYLOAD).alias("d"))
    rows = doc.select("d.series_id", "d.units", F.explode("d.observations").alias("o"))
    text = F.trim("o.value")
    start = F.col("o.realtime_start").try_cast("date")
    release = F.col("o.release_date").try_cast("date")
    return rows.select(
        "series_id",
        "units",
        F.col("o.date").try_cast("date").alias("observation_date"),
        start.alias("realtime_start"),
        F.col("o.realtime_end").try_cast("date").alias("realtime_end"),
        F.coalesce(release, start).alias("availability_date"),
        F.when(~text.isin(".", ""), text.try_cast("double")).alias("value"),
    )


def scan(spark: SparkSession, path: str, predicate: Column | None = None) -> DataFrame:
    """Partitioned scan; a predicate on the partition columns prunes folders."""
    df = spark.read.parquet(path)
    return df if predicate is None else df.where(predicate)


def write_partitioned(
    df: DataFrame, path: str, keys: Sequence[str], sort: Sequence[str]
) -> None:
    """Partitioned Parquet in a stable order; what the folder held before is replaced.

    Ranges over keys and sort columns split a hot partition value over several tasks.
    """
    (
        df.repartitionByRange(*keys, *sort)
        .sortWithinPartitions(*keys, *sort)
        .write.mode("overwrite")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """CSV with a header; the part files follow one another in the given order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def register(df: DataFrame, path: str, name: str) -> DataFrame:
    """Store a dataset once (an existing one is never overwritten) and name it for SQL."""
    df.write.mode("errorifexists").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.createOrReplaceTempView(name)
    return stored


def profile(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Rows, coverage, distinct keys and nulls per column, in one pass."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(period).alias("coverage_min"),
        F.max(period).alias("coverage_max"),
        F.count_distinct(F.struct(*keys)).alias("distinct_keys"),
        *nulls,
    )


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-independent content fingerprint: one row, additive over partitions.

    Values go in with their lengths, so no two rows read alike, and hashes are summed, so repeated
    rows count as often as they stand.
    """
    cols = list(columns or sorted(df.columns))
    texts = [col(c).cast("string") for c in cols]
    tagged = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("null")) for t in texts]
    row = F.xxhash64(*tagged)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(hash32(*tagged)).alias("md5_sum"),
        F.sum(row.cast("decimal(20,0)")).alias("xxhash_sum"),
        F.bit_xor(row).alias("xxhash_xor"),
    )


