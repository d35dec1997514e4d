"""Checks that return tables: diagnostics, conservation, coverage and consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import count_where, join_null_safe, ordered, ratio, scalars, total


def missingness(df: DataFrame) -> DataFrame:
    """Null count and rate of every column, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[count_where(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    )
    return counts.select(F.inline(rows), "_rows").select(
        "column", "nulls", ratio(F.col("nulls"), F.col("_rows")).alias("null_rate")
    )


def trip_diagnostics(df: DataFrame) -> DataFrame:
    """Suppression, rounding and validity counts of clean trips, as one row."""
    p, d = (
        F.col("pickup_census_tract_missing_or_suppressed"),
        F.col("dropoff_census_tract_missing_or_suppressed"),
    )

    def status(c: Column) -> Column:
        known, n = F.count(c), F.count(F.lit(1))
        return F.when(known == n, "available").when(known == 0, "unavailable").otherwise("partial")

    def rate(c: str) -> Column:
        return ratio(F.count_if(F.col(c)), F.count(c))

    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("source").alias("sources"),
        F.count_if(p).alias("pickup_suppressed"),
        ratio(F.count_if(p), F.count(p)).alias("pickup_suppressed_rate"),
        status(p).alias("pickup_indicator_status"),
        F.count_if(d).alias("dropoff_suppressed"),
        status(d).alias("dropoff_indicator_status"),
        rate("pickup_on_15_minute_grid").alias("pickup_on_grid_rate"),
        rate("fare_on_declared_grid").alias("fare_on_grid_rate"),
        (F.count("trip_id") - F.count_distinct("trip_id")).alias("duplicate_trip_ids"),
        count_where(F.col("trip_id").isNull()).alias("missing_trip_ids"),
        count_where(F.col("trip_seconds") <= 0).alias("nonpositive_trip_seconds"),
        count_where(F.col("trip_miles") < 0).alias("negative_trip_miles"),
        count_where(F.col("fare") < 0).alias("negative_fares"),
        count_where(F.col("pickup_datetime_utc").isNull()).alias("utc_conversion_nulls"),
    )


def conservation(clean: DataFrame, zones: DataFrame, od: DataFrame) -> DataFrame:
    """Trips must be the same in the log, the zone panel and the flows; keys must be unique."""
    a = clean.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        count_where(F.col("pickup_datetime").isNull()).alias("pickup_datetime_null_rows"),
        F.min("pickup_datetime").alias("pickup_min"),
        F.max("pickup_datetime").alias("pickup_max"),
    )
    z = zones.agg(
        F.count(F.lit(1)).alias("zone_rows"),
        F.sum("trip_count").alias("zone_trip_sum"),
        (
            F.count(F.lit(1))
            - F.count_distinct(F.struct("source", "zone_type", "zone_id", "time_bin"))
        ).alias("zone_key_duplicates"),
        count_where(F.col("trip_count") == 0).alias("zero_trip_cells"),
    )
    o = od.agg(
        F.count(F.lit(1)).alias("od_rows"),
        F.sum("trip_count").alias("od_trip_sum"),
        (
            F.count(F.lit(1))
            - F.count_distinct(
                F.struct("source", "origin_zone_id", "destination_zone_id", "time_bin")
            )
        ).alias("od_key_duplicates"),
        count_where(F.col("trip_count") <= 0).alias("nonpositive_od_rows"),
    )
    out = a
    for part in (z, o):
        out = out.withColumns(scalars(part))
    usable = F.col("clean_rows") - F.col("pickup_datetime_null_rows")
    return out.withColumn(
        "conserved", (F.col("zone_trip_sum") == usable) & (F.col("od_trip_sum") == usable)
    )


def calendar_coverage(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Dates and date-hours of a period without any row, and dates outside it."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    calendar = df.sparkSession.range(1).select(F.explode(days).alias("service_date"))
    hours = calendar.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    seen = df.select(F.to_date(ts).alias("service_date"), F.hour(ts).alias("hour")).distinct()
    dates = seen.select("service_date").distinct()
    none = F.lit(None).cast("int").alias("hour")
    missing_days = calendar.join(dates, "service_date", "left_anti").select(
        F.lit("missing_date").alias("kind"), "service_date", none
    )
    missing_hours = hours.join(seen, ["service_date", "hour"], "left_anti").select(
        F.lit("missing_date_hour").alias("kind"), "service_date", "hour"
    )
    outside = dates.where(
        ~F.col("service_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    ).select(F.lit("outside_period").alias("kind"), "service_date", none)
    return missing_days.unionByName(missing_hours).unionByName(outside)


def edge_checks(edges: DataFrame) -> DataFrame:
    """An exposure map has unique pairs, no self edges, positive weights, and is symmetric.

    Every edge counts once, however often its pair or the reverse pair is repeated; an edge is
    uneven when any reverse edge is missing or differs in weight.
    """
    pair = ["focal_zone_id", "neighbor_zone_id"]
    reverse = edges.groupBy(
        F.col("neighbor_zone_id").alias("focal_zone_id"),
        F.col("focal_zone_id").alias("neighbor_zone_id"),
    ).agg(F.min("weight").alias("_least"), F.max("weight").alias("_most"))
    both = edges.join(reverse, pair, "left")
    weight = F.col("weight")
    uneven = (
        F.col("_least").isNull()
        | (F.abs(weight - F.col("_least")) > 1e-12)
        | (F.abs(weight - F.col("_most")) > 1e-12)
    )
    return both.agg(
        F.count(F.lit(1)).alias("edges"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*pair))).alias("duplicate_pairs"),
        count_where(F.col("focal_zone_id") == F.col("neighbor_zone_id")).alias("self_edges"),
        count_where(~(F.col("weight") > 0)).alias("nonpositive_weights"),
        count_where(uneven).alias("asymmetric_edges"),
        F.count_distinct("focal_zone_id").alias("focal_zones"),
    )


def consistency(
    split: DataFrame, gains: DataFrame, totals: DataFrame, tolerance: float = 1e-6
) -> DataFrame:
    """Parts must sum to the totals they partition, within a relative tolerance."""
    pairs = [
        ("treated_change", total(split, F.sum("treated_change")), "treated_total"),
        ("alternative_change", total(split, F.sum("alternative_change")), "alternative_total"),
        ("pre_treated_value", total(split, F.sum("pre_treated_value")), "pre_treated_value"),
        (
            "partner_gains",
            total(gains, F.sum(F.when(~F.col("is_treated_country"), F.col("change")))),
            "alternative_total",
        ),
    ]
    row = totals.select(
        *[F.col(t).alias(f"_t{i}") for i, (_, _, t) in enumerate(pairs)],
        *[part.alias(f"_p{i}") for i, (_, part, _) in enumerate(pairs)],
    )
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.col(f"_p{i}").alias("parts"),
                F.col(f"_t{i}").alias("whole"),
            )
            for i, (name, _, _) in enumerate(pairs)
        ]
    )
    gap = F.abs(F.col("parts") - F.col("whole"))
    return row.select(F.inline(table)).withColumn(
        "passed", (F.col("whole") == 0) | (gap <= tolerance * F.abs(F.col("whole")))
    )


def trade_checks(
    panel: DataFrame,
    countries: Sequence[str],
    z_cut: float = 5.0,
    jump: float = 2.5,
    product: str = "hs10",
) -> DataFrame:
    """The battery of trade-panel checks as a check table."""
    c, m = "country_code", "month_date"
    flow = [product, c]
    n = total(panel, F.count(F.lit(1)))
    value, q = F.col("customs_value"), F.coalesce("quantity", F.lit(0.0))
    duties = F.coalesce("calculated_duties", F.lit(0.0))
    modelled = F.col("total_modeled_tariff_rate")
    realised = F.col("realised_duty_rate_on_dutiable")
    comparable = realised.isNotNull() & modelled.isNotNull() & (value > 0)
    unit = F.when(F.col("quantity_unit") != "", F.col("quantity_unit"))
    rows = panel.agg(
        count_where(~F.col(c).isin(*countries)).alias("BAD_COUNTRY"),
        count_where(~F.col(product).rlike(r"^\d{6}(\d{2})?(\d{2})?$")).alias("BAD_PRODUCT_CODE"),
        count_where((value < 0) | (q < 0) | (duties < 0)).alias("NEGATIVE_VALUES"),
        count_where((value > 0) & (q <= 0)).alias("ZERO_QUANTITY_POSITIVE_VALUE"),
        count_where(comparable & (F.abs(realised - modelled) > 0.03)).alias("DUTY_VS_ENGINE"),
        count_where((F.coalesce(modelled, F.lit(0.0)) > 0) & (value > 0) & (duties <= 0)).alias(
            "MISSING_DUTIES"
        ),
        count_where(~F.coalesce("tariff_usable_for_treatment", F.lit(False))).alias(
            "TARIFF_AMBIGUOUS"
        ),
        count_where(comparable).alias("_comparable"),
    )
    keys = panel.groupBy(*flow, m).agg(F.count(F.lit(1)).alias("k"))
    months = total(panel, F.count_distinct(m))
    flows = panel.groupBy(*flow).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct(unit).alias("_units"),
        F.percentile("log_customs_unit_value", 0.5).alias("_med"),
        F.stddev_samp("log_customs_unit_value").alias("_sd"),
    )
    x = F.col("log_customs_unit_value")
    scored = join_null_safe(panel, flows.select(*flow, "_med", "_sd"), flow)
    extreme = (F.col("_sd") > 0) & (F.abs(x - F.col("_med")) / F.col("_sd") > z_cut)
    step = F.col("log_customs_value") - F.lag("log_customs_value").over(ordered(flow, m))
    jumps = panel.select(step.alias("_d"))
    extra = {
        "DUP_KEY": total(keys, F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k") - 1)), F.lit(0))),
        "UNIT_CHANGE": total(flows, count_where(F.col("_units") > 1)),
        "EXTREME_UNIT_VALUE": total(scored, count_where(extreme)),
        "TRADE_JUMP": total(jumps, count_where(F.abs("_d") > jump)),
        "PANEL_GAPS": total(flows, count_where(F.col("_n") < months)),
    }
    facts = rows.withColumns(
        {**extra, "_rows": n, "_flows": total(flows, F.count(F.lit(1)))}
    )
    checks = [
        ("DUP_KEY", "ERROR", "_rows"),
        ("BAD_COUNTRY", "ERROR", "_rows"),
        ("BAD_PRODUCT_CODE", "ERROR", "_rows"),
        ("UNIT_CHANGE", "ERROR", "_rows"),
        ("NEGATIVE_VALUES", "ERROR", "_rows"),
        ("ZERO_QUANTITY_POSITIVE_VALUE", "WARN", "_rows"),
        ("EXTREME_UNIT_VALUE", "WARN", "_rows"),
        ("DUTY_VS_ENGINE", "WARN", "_comparable"),
        ("MISSING_DUTIES", "WARN", "_rows"),
        ("TRADE_JUMP", "INFO", "_rows"),
        ("PANEL_GAPS", "INFO", "_flows"),
        ("TARIFF_AMBIGUOUS", "WARN", "_rows"),
    ]
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_id"),
                F.lit(level).alias("severity"),
                F.col(name).cast("bigint").alias("n_flagged"),
                F.col(of).cast("bigint").alias("n_total"),
            )
            for name, level, of in checks
        ]
    )
    return facts.select(F.inline(table)).withColumn("passed", F.col("n_flagged") == 0)
