"""Areas and days: binned distributions, allocation, event days and daily signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymetrics.core import ratio, rows_to_here, total
from quaymetrics.functions.columns import iso_weekday


def grouped_median(bins: DataFrame, area: Sequence[str], count: str = "households") -> DataFrame:
    """Median of a binned distribution by interpolation; the open top bin is flagged.

    `bins` has one row per area and bin with `lower` and `upper` (null for the open bin).
    """
    run = F.sum(count).over(rows_to_here(area, "bin"))
    whole = bins.groupBy(*area).agg(F.sum(count).alias("_all"))
    placed = bins.withColumn("_cum", run).join(whole, list(area))
    hit = placed.where((F.col("_all") > 0) & (F.col("_cum") >= 0.5 * F.col("_all")))
    first = hit.groupBy(*area).agg(
        F.min_by(F.struct("lower", "upper", "_cum", F.col(count).alias("n"), "_all"), "bin").alias(
            "h"
        )
    )
    part = ratio(0.5 * F.col("h._all") - (F.col("h._cum") - F.col("h.n")), F.col("h.n"))
    part = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    open_bin = F.col("h.upper").isNull()
    inside = F.col("h.lower") + part * (F.col("h.upper") - F.col("h.lower"))
    return first.select(
        *area,
        F.when(open_bin, F.col("h.lower")).otherwise(inside).alias("grouped_median"),
        open_bin.alias("top_coded"),
    )


def binned_income(
    tracts: DataFrame, mapping: DataFrame, low: float, high: float
) -> DataFrame:
    """Bin counts summed to areas, margins as the root of summed squares, grouped median.

    The median comes from the summed bins, never from medians of the parts.
    """
    mapped = tracts.join(mapping, "tract")
    bins = mapped.groupBy("area", "bin", "lower", "upper").agg(
        F.sum("households").alias("households"),
        F.sqrt(F.sum(F.col("moe") * F.col("moe"))).alias("moe"),
    )
    n = F.col("households")
    totals = bins.groupBy("area").agg(
        F.sum(n).alias("households"),
        F.sqrt(F.sum(F.col("moe") * F.col("moe"))).alias("moe"),
        ratio(F.sum(F.when(F.col("upper") <= low, n).otherwise(0)), F.sum(n)).alias("share_low"),
        ratio(F.sum(F.when(F.col("lower") >= high, n).otherwise(0)), F.sum(n)).alias("share_high"),
    )
    return totals.join(grouped_median(bins, ["area"]), "area", "left")


def allocate(
    crosswalk: DataFrame, bins: DataFrame, city_median: Column, minimum: float
) -> DataFrame:
    """Area distributions spread over zones by weight, then classified by grouped median.

    `crosswalk` is (zone, area, weight); weights of an area sum to one and the check column
    carries the largest departure among the zone's areas.
    """
    sums = crosswalk.groupBy("area").agg(F.sum("weight").alias("_w"))
    spread = (
        crosswalk.join(sums, "area")
        .join(bins, "area")
        .groupBy("zone", "bin", "lower", "upper")
        .agg(
            F.sum(F.col("weight") * F.col("households")).alias("households"),
            F.max(F.abs(F.col("_w") - 1.0)).alias("_off"),
        )
    )
    zones = spread.groupBy("zone").agg(
        F.sum("households").alias("households"), F.max("_off").alias("weight_sum_error")
    )
    median = grouped_median(spread, ["zone"])
    known = (F.col("households") >= minimum) & F.col("grouped_median").isNotNull()
    group = (
        F.when(known & (F.col("grouped_median") < city_median), "low_income_area")
        .when(known, "high_income_area")
        .otherwise("unclassified")
    )
    return zones.join(median, "zone", "left").withColumn("income_group", group)


# --- activity by group ------------------------------------------------------------


def daily_zones(panel: DataFrame) -> DataFrame:
    return panel.groupBy("zone_id", F.to_date("time_bin").alias("service_date")).agg(
        F.count(F.lit(1)).alias("zone_hours"),
        F.count_if(F.col("trip_count") > 0).alias("occupied_zone_hours"),
        F.sum("trip_count").alias("published_completed_trips"),
    )


def _grouped(panel: DataFrame, groups: DataFrame) -> DataFrame:
    return (
        daily_zones(panel)
        .join(groups.select("zone_id", "income_group"), "zone_id", "left")
        .withColumn("income_group", F.coalesce("income_group", F.lit("unclassified")))
    )


def _activity() -> list[Column]:
    return [
        F.count_distinct("zone_id").alias("panel_zones"),
        F.sum("zone_hours").alias("zone_hours"),
        F.sum("occupied_zone_hours").alias("occupied_zone_hours"),
        F.sum("published_completed_trips").alias("published_completed_trips"),
        ratio(F.sum("published_completed_trips"), F.sum("zone_hours")).alias(
            "mean_trips_per_zone_hour"
        ),
    ]


def group_daily(panel: DataFrame, groups: DataFrame) -> DataFrame:
    return _grouped(panel, groups).groupBy("service_date", "income_group").agg(*_activity())


def group_monthly(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Month activity by area group, with shares of all and of classified trips."""
    month = (
        _grouped(panel, groups)
        .groupBy("income_group")
        .agg(*_activity(), F.count_distinct("service_date").alias("observed_days"))
    )
    n, classified = F.col("published_completed_trips"), F.col("income_group") != "unclassified"
    # one row per group by now, so the whole is summed over the groups and nothing is read again
    groups_of_all = Window.partitionBy()
    everything = F.sum(n).over(groups_of_all)
    known = F.sum(F.when(classified, n)).over(groups_of_all)
    return month.withColumns(
        {
            "mean_daily_trips": ratio(n, F.col("observed_days")),
            "share_of_all_trips": ratio(n, everything),
            "share_of_classified_trips": F.when(classified, ratio(n, known)),
        }
    )


def group_zones(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Every official or observed zone with its activity; a full join keeps both kinds."""
    seen = (
        daily_zones(panel)
        .groupBy("zone_id")
        .agg(
            F.count(F.lit(1)).alias("panel_days"),
            F.sum("zone_hours").alias("zone_hours"),
            F.sum("published_completed_trips").alias("published_completed_trips"),
            F.lit(True).alias("_seen"),
        )
    )
    official = groups.select("zone_id", "income_group", F.lit(True).alias("_official"))
    return official.join(seen, "zone_id", "full").select(
        "zone_id",
        F.coalesce("income_group", F.lit("unclassified")).alias("income_group"),
        F.col("_official").isNotNull().alias("official_zone"),
        F.col("_seen").isNotNull().alias("observed_in_panel"),
        "panel_days",
        "zone_hours",
        "published_completed_trips",
    )


# --- interval days ----------------------------------------------------------------


def flag_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    ok = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start))
    return df.withColumn("usable", ok)


def expand_days(
    df: DataFrame, key: str, start: str, end: str, first: str, last: str
) -> DataFrame:
    """Half-open intervals to one row per day and key, clipped to the period.

    An interval ending at midnight does not touch that day. Unusable intervals are left out.
    """
    lo = F.greatest(F.to_date(start), F.lit(first).cast("date"))
    last_moment = F.col(end) - F.expr("interval 0.000001 seconds")
    hi = F.least(F.to_date(last_moment), F.lit(last).cast("date"))
    good = flag_intervals(df, start, end).where(F.col("usable") & (lo <= hi))
    days = good.withColumn("service_date", F.explode(F.sequence(lo, hi))).drop("usable")
    return days.dropDuplicates([key, "service_date"])


def major_names(days: DataFrame) -> DataFrame:
    """The distinct names of each day's major events, one row per day and name."""
    return days.where("major").select("service_date", "event_name").distinct()


def event_calendar(days: DataFrame, first: str, last: str) -> DataFrame:
    """Every day of the period with active ids, conditional counts and its sorted major names, their
    number and the first.

    Distinct names are found before they are listed, so a busy day gathers names, not rows.
    """
    bounds = [F.lit(first).cast("date"), F.lit(last).cast("date")]
    calendar = days.sparkSession.range(1).select(
        F.explode(F.sequence(*bounds)).alias("service_date")
    )
    daily = days.groupBy("service_date").agg(
        F.count_distinct("event_id").alias("active_events"),
        F.count_if("public").alias("active_public_events"),
        F.count_if("major").alias("active_major_events"),
    )
    names = major_names(days).groupBy("service_date").agg(
        F.count("event_name").alias("n_major_names"),
        F.min("event_name").alias("first_major_name"),
        F.array_join(F.array_sort(F.collect_list("event_name")), " | ").alias("major_names"),
    )
    table = (
        calendar.join(daily, "service_date", "left")
        .join(names, "service_date", "left")
        .fillna(0, ["active_events", "active_public_events", "active_major_events", "n_major_names"])
        .fillna("", ["major_names"])
    )
    median = total(table, F.percentile("active_events", 0.5))
    return table.withColumns(
        {
            "is_major_day": F.col("active_major_events") > 0,
            "median_active_events": median,
            "above_median_day": F.col("active_events") > median,
        }
    )


# --- daily signals against demand -------------------------------------------------


def signal_associations(
    panel: DataFrame, calendar: DataFrame, flag: str, signal: str
) -> DataFrame:
    """Daily demand against a signal: contrast, correlation, and within-weekday correlation."""
    daily = (
        panel.groupBy(F.to_date("time_bin").alias("service_date"))
        .agg(F.sum("trip_count").alias("trips"))
        .join(calendar.select("service_date", flag, signal), "service_date")
        .withColumn("iso_weekday", iso_weekday("service_date"))
    )
    means = daily.groupBy("iso_weekday").agg(
        F.avg("trips").alias("_mt"), F.avg(signal).alias("_ms")
    )
    centred = daily.join(means, "iso_weekday")
    on = F.col(flag)
    hi, lo = F.avg(F.when(on, F.col("trips"))), F.avg(F.when(~on, F.col("trips")))
    return centred.agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(on).alias("exposed_days"),
        F.count_if(~on).alias("comparison_days"),
        hi.alias("mean_exposed"),
        lo.alias("mean_comparison"),
        (hi - lo).alias("difference"),
        ratio(hi - lo, lo).alias("relative_difference"),
        F.corr("trips", signal).alias("correlation"),
        F.corr(F.col("trips") - F.col("_mt"), F.col(signal) - F.col("_ms")).alias(
            "within_weekday_correlation"
        ),
    )


def hourly_contrast(panel: DataFrame, calendar: DataFrame, flag: str) -> DataFrame:
    """Mean demand by hour under each value of a daily flag, side by side."""
    hourly = (
        panel.groupBy(F.to_date("time_bin").alias("service_date"), F.hour("time_bin").alias("hour"))
        .agg(F.sum("trip_count").alias("trips"))
        .join(calendar.select("service_date", flag), "service_date")
    )
    wide = (
        hourly.groupBy("hour")
        .pivot(flag, [True, False])
        .agg(F.count(F.lit(1)).alias("days"), F.avg("trips").alias("mean"))
    )
    return wide.select(
        "hour",
        F.coalesce("true_days", F.lit(0)).alias("days_on"),
        F.coalesce("false_days", F.lit(0)).alias("days_off"),
        F.col("true_mean").alias("mean_on"),
        F.col("false_mean").alias("mean_off"),
        (F.col("true_mean") - F.col("false_mean")).alias("on_minus_off"),
    )


