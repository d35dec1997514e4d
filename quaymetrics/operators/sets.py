"""Unions, de-duplication, order and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import running_total
from quaymetrics.session import stored


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def diagonal_concat(*frames: DataFrame) -> DataFrame:
    """Union of the columns; what a branch lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key, the first in order.

    The winner is kept by an aggregate over an ordered struct, so copies of one key are
    reduced before the shuffle and are never gathered or sorted.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    rank = F.struct(*order)
    pick = F.max_by(row, rank) if last else F.min_by(row, rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the least metric per group, ties by the following columns."""
    return dedup(df, group, order)


def top_k(df: DataFrame, k: int, order: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def total_order(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Position of every row in the order.

    Rows are dealt to ranges whose bounds are sampled from the data by the whole order, so that
    many rows in a narrow band spread over many ranges; each range is then ranked on its own. The
    dealt rows are stored, as sampled bounds may differ from one run of the plan to the next.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    return running_total(stored(ranged, "ranges"), [], "_range", order, F.lit(1), out).drop("_range")


def pivot_measures(
    long: DataFrame, keys: Sequence[str], measure: str, names: Sequence[str], value: str
) -> DataFrame:
    """Long measures to columns: sum and count of each named measure per key.

    The names are given, so no pass over the data is spent finding them. A measure a key lacks
    has a null sum and a zero count.
    """
    c = F.col(measure)
    cells = [
        e
        for n in names
        for e in (
            F.sum(F.when(c == n, F.col(value))).alias(f"{n}_sum"),
            F.count(F.when(c == n, F.col(value))).alias(f"{n}_count"),
        )
    ]
    return long.groupBy(*keys).agg(*cells)
