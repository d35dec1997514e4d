"""Row, entity and period selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymetrics.core import hash32, hash_rank, join_null_safe, total

SCALE = 1_000_000


def truncate_after_exit(panel: DataFrame, events: DataFrame, key: str, period: str) -> DataFrame:
    """Entity-months up to the resolved end of observation; entities without events drop."""
    ends = events.select(key, "observation_end")
    return panel.join(ends, key).where(F.col(period) <= F.col("observation_end"))


def restrict(df: DataFrame, column: str, values: Sequence[str] | DataFrame) -> DataFrame:
    """Keep rows whose status or code is listed (a literal list, or a keep-list table)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(*values))


def draw(key: str | Column, fraction: float, salt: str = "") -> Column:
    """Stable yes/no draw for a key."""
    return F.pmod(hash32(key, salt=salt), F.lit(SCALE)) < int(fraction * SCALE)


def sample_entities(df: DataFrame, key: str, fraction: float, salt: str = "") -> DataFrame:
    """All rows of an entity are kept or dropped together."""
    return df.where(draw(key, fraction, salt))


def case_cohort(
    df: DataFrame, key: str, event: Column, fraction: float, salt: str = ""
) -> DataFrame:
    """Every entity that ever exits is kept, others are drawn whole.

    The weight is the reciprocal of the inclusion probability of the row's entity.
    """
    cases = df.where(event).select(key).distinct().withColumn("ever_event", F.lit(True))
    flagged = df.join(cases, key, "left").withColumn(
        "ever_event", F.coalesce("ever_event", F.lit(False))
    )
    return flagged.where(F.col("ever_event") | draw(key, fraction, salt)).withColumn(
        "sampling_weight", F.when(F.col("ever_event"), 1.0).otherwise(1.0 / fraction)
    )


def quota_sample(
    df: DataFrame, strata: Sequence[str], n: int, hash_value: Column, ties: Sequence[str]
) -> DataFrame:
    """Exactly n rows split evenly over the strata, the remainder on the first ones.

    Within a stratum rows are taken in stable hash order.
    """
    names = list(strata)
    index = df.select(*names).distinct().withColumn(
        "_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*names)) - 1
    )
    count = total(df, F.count_distinct(F.struct(*names)))
    quotas = index.withColumn(
        "_quota",
        F.floor(F.lit(n) / count)
        + F.when(F.col("_i") < F.pmod(F.lit(n).cast("bigint"), count), 1).otherwise(0),
    )
    ranked = hash_rank(df, names, hash_value, ties, "_rank")
    return (
        join_null_safe(ranked, quotas.drop("_i"), names, "inner")
        .where(F.col("_rank") <= F.col("_quota"))
        .drop("_rank", "_quota")
    )


def min_support(df: DataFrame, group: str, count: str, threshold: float) -> DataFrame:
    """Groups whose median count reaches the threshold."""
    keep = (
        df.groupBy(group)
        .agg(F.percentile(count, 0.5).alias("_median"))
        .where(F.col("_median") >= threshold)
    )
    return df.join(keep.select(group), group, "left_semi")


def complete_periods(
    df: DataFrame, entity: Sequence[str], date: str, value: Column, out: str, months: int = 12
) -> DataFrame:
    """Yearly sums over years in which every month was observed."""
    return (
        df.groupBy(*entity, F.year(date).alias("year"))
        .agg(F.sum(value).alias(out), F.count(F.lit(1)).alias("n_months"))
        .where(F.col("n_months") == months)
    )


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every listed column; numbers must be finite."""
    out = df.dropna(subset=list(columns))
    for name in columns:
        if out.schema[name].dataType.typeName() in ("double", "float"):
            c = F.col(name)
            out = out.where(~F.isnan(c) & (F.abs(c) != float("inf")))
    return out


def period_blocks(df: DataFrame, period: str, n_tune: int, n_final: int) -> DataFrame:
    """Label every row by the chronological block its period falls in.

    Ranks run over the distinct periods (a calendar), never over the rows.
    """
    ranks = df.select(period).distinct().withColumn(
        "_from_end", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(period)))
    )
    r = F.col("_from_end")
    block = (
        F.when(r <= n_final, "final_evaluation")
        .when(r <= n_final + n_tune, "tuning_validation")
        .otherwise("model_development")
    )
    return df.join(ranks.withColumn("evaluation_block", block).drop("_from_end"), period)


def select_concept(
    df: DataFrame, flavor: str, frequency: str, level: str, seasonal: str = "nsa"
) -> DataFrame:
    """One index concept of a long multi-concept table.

    Where the seasonally adjusted index is wholly absent the unadjusted one is used and
    labelled as such.
    """
    chosen = df.where(
        (F.col("hpi_flavor") == flavor)
        & (F.col("frequency") == frequency)
        & (F.col("level") == level)
    )
    want = F.col(f"index_{seasonal}")
    available = total(chosen, F.count(want)) > 0
    step = 1 if frequency == "monthly" else 3
    month = (F.col("period") - 1) * step + 1
    return chosen.select(
        F.col("place_id").alias("geography"),
        "place_name",
        F.make_date("yr", month, F.lit(1)).alias("period"),
        F.when(available, want).otherwise(F.col("index_nsa")).cast("double").alias("hpi"),
        F.when(available, F.lit(seasonal))
        .otherwise(F.lit("nsa (sa unavailable for this concept)"))
        .alias("index_basis"),
        F.lit(flavor).alias("hpi_flavor"),
        F.lit(frequency).alias("hpi_frequency"),
        F.lit(level).alias("hpi_level"),
    ).where(F.col("hpi").isNotNull())
