"""Bitemporal series: what was known when.

A vintage row is (series_id, observation_date, realtime_start, value) with an availability.
A cell is (series_id, observation_date). A missing value in the latest vintage is a fact and
wins the ranking, so nulls are never dropped before the latest vintage is chosen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import asof_backward, newest_before, ordered, ratio, require_none
from quaymetrics.functions.columns import transform
from quaymetrics.operators.sets import dedup

CELL = ("series_id", "observation_date")
AVAILABLE = "effective_availability"

# Labels of the three information sets.
AS_OF = "as_of"
SAME_MASK = "latest_values_same_eligibility_mask"
NAIVE = "naive_latest_revised"


def with_availability(vintages: DataFrame) -> DataFrame:
    """Date-only availability counts from the last microsecond of the day (UTC)."""
    end = F.col("availability_date").cast("timestamp_ntz") + F.expr(
        "interval 23 hours 59 minutes 59.999999 seconds"
    )
    if "availability_timestamp" in vintages.columns:
        end = F.coalesce(F.col("availability_timestamp").cast("timestamp_ntz"), end)
    return vintages.withColumn(AVAILABLE, end)


def check_vintages(vintages: DataFrame) -> DataFrame:
    """Rows violating the vintage key: one row per (series, observation, realtime start)."""
    return (
        vintages.groupBy(*CELL, "realtime_start")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key under a composite order, null values included."""
    return dedup(df, keys, order, last=True)


def latest_per_cell(known: DataFrame) -> DataFrame:
    return latest(known, CELL, [AVAILABLE, "realtime_start"])


def _labelled(df: DataFrame, cutoff: Column, mode: str) -> DataFrame:
    return df.withColumns(
        {
            "information_set_mode": F.lit(mode),
            "is_counterfactual": F.lit(mode != AS_OF),
            "as_of_timestamp": cutoff,
        }
    )


def _cutoff(ts: str) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


def as_of(vintages: DataFrame, ts: str) -> DataFrame:
    """The latest vintage of every cell available at the cutoff."""
    known = with_availability(vintages).where(F.col(AVAILABLE) <= _cutoff(ts))
    out = latest_per_cell(known).withColumns(
        {
            "eligibility_timestamp": F.col(AVAILABLE),
            "selected_vintage_availability_timestamp": F.col(AVAILABLE),
        }
    )
    return _labelled(out, _cutoff(ts), AS_OF)


def _first_available(known: DataFrame) -> DataFrame:
    return known.groupBy(*CELL).agg(F.min(AVAILABLE).alias("eligibility_timestamp"))


def _latest_with_first(vintages: DataFrame) -> DataFrame:
    """Latest vintage and first availability of every cell, in one aggregation."""
    known = with_availability(vintages)
    rest = [c for c in known.columns if c not in CELL]
    pick = F.max_by(F.struct(*rest), F.struct(AVAILABLE, "realtime_start"))
    return (
        known.groupBy(*CELL)
        .agg(pick.alias("_row"), F.min(AVAILABLE).alias("eligibility_timestamp"))
        .select(*CELL, "_row.*", "eligibility_timestamp")
        .withColumn("selected_vintage_availability_timestamp", F.col(AVAILABLE))
    )


def latest_same_mask(vintages: DataFrame, ts: str) -> DataFrame:
    """Counterfactual: final values, but only for cells first available by the cutoff."""
    cells = _latest_with_first(vintages).where(F.col("eligibility_timestamp") <= _cutoff(ts))
    return _labelled(cells, _cutoff(ts), SAME_MASK)


def naive_latest(vintages: DataFrame, ts: str) -> DataFrame:
    """Leaky benchmark: final values of every cell; first availability is kept for audit."""
    return _labelled(_latest_with_first(vintages), _cutoff(ts), NAIVE)


def future_violations(df: DataFrame) -> DataFrame:
    """Count of rows known only after their own cutoff."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.col(AVAILABLE) > F.col("as_of_timestamp")).alias("future_rows"),
        F.count_if(F.col("is_counterfactual")).alias("counterfactual_rows"),
    )


def assert_no_future(df: DataFrame) -> None:
    require_none(df, F.col("is_counterfactual"), "counterfactual rows are not as-of rows")
    require_none(df, F.col(AVAILABLE) > F.col("as_of_timestamp"), "future information")


# --- revisions --------------------------------------------------------------------


def revision_details(vintages: DataFrame) -> DataFrame:
    """First against latest value of every cell."""
    order = F.struct("availability_date", "realtime_start")
    row = F.struct("value", "availability_date")
    return (
        vintages.groupBy(*CELL)
        .agg(
            F.min_by(row, order).alias("_a"),
            F.max_by(row, order).alias("_z"),
            F.count(F.lit(1)).alias("vintage_count"),
        )
        .select(
            *CELL,
            F.col("_a.value").alias("first_value"),
            F.col("_z.value").alias("latest_value"),
            F.col("_a.availability_date").alias("first_availability"),
            F.col("_z.availability_date").alias("latest_availability"),
            "vintage_count",
            (F.col("_z.value") - F.col("_a.value")).alias("revision"),
            F.abs(F.col("_z.value") - F.col("_a.value")).alias("absolute_revision"),
        )
    )


def revision_summary(vintages: DataFrame) -> DataFrame:
    return (
        revision_details(vintages)
        .where(F.col("first_value").isNotNull() & F.col("latest_value").isNotNull())
        .groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("observation_count"),
            F.count_if(F.col("absolute_revision") > 0).alias("revision_count"),
            F.avg("revision").alias("mean_revision"),
            F.avg("absolute_revision").alias("mean_abs_revision"),
            F.max("absolute_revision").alias("max_abs_revision"),
        )
    )


def release_events(vintages: DataFrame) -> DataFrame:
    """Number the vintages of every cell; the first is the initial release."""
    number = F.row_number().over(ordered(CELL, "availability_date", "realtime_start"))
    return vintages.withColumn("revision_number", number).select(
        F.concat(
            F.col("series_id"),
            F.lit("-"),
            F.col("observation_date").cast("string"),
            F.lit("-v"),
            F.col("revision_number").cast("string"),
        ).alias("release_id"),
        *CELL,
        F.col("availability_date").alias("release_date"),
        F.when(F.col("revision_number") == 1, "initial")
        .otherwise("revision")
        .alias("release_type"),
        "revision_number",
    )


def realtime_ends(vintages: DataFrame) -> DataFrame:
    """A vintage is current until the day before the next one starts."""
    following = F.lead("realtime_start").over(ordered(CELL, "realtime_start"))
    return vintages.withColumn("realtime_end", F.date_sub(following, 1))


# --- calendars --------------------------------------------------------------------


def forecast_origins(
    calendar: DataFrame, lead: str = "interval 1 second", tz: str = "America/New_York"
) -> DataFrame:
    """Origins strictly before each initial release.

    An exact release time gives release minus the lead; a date-only one gives the last
    microsecond of the previous day in the local zone.
    """
    release = F.col("release_timestamp")
    midnight = F.to_utc_timestamp(F.to_date(release).cast("timestamp"), tz)
    date_only = midnight - F.expr("interval 0.000001 seconds")
    origin = F.when(F.col("timing_quality") == "date_only", date_only).otherwise(
        release - F.expr(lead)
    )
    return calendar.where(F.col("release_type") == "initial").select(
        F.concat_ws(":", "series_id", F.col("observation_date").cast("string")).alias(
            "forecast_id"
        ),
        F.col("series_id").alias("target_series_id"),
        F.col("observation_date").alias("target_period"),
        origin.alias("forecast_origin"),
        release.alias("target_release_timestamp"),
    )


def calendar_violations(calendar: DataFrame) -> DataFrame:
    """Counts of each kind of defect of a release calendar."""
    initial = F.when(F.col("release_type") == "initial", F.struct(*CELL))
    after = F.to_date("release_timestamp") > F.col("observation_date")
    return calendar.agg(
        F.count_if(F.col("release_timestamp").isNull()).alias("null_release"),
        (F.count(F.lit(1)) - F.count_distinct("release_id")).alias("duplicate_ids"),
        (F.count(initial) - F.count_distinct(initial)).alias("extra_initial_releases"),
        F.count_if(~after).alias("released_before_period"),
    )


def validate_calendar(calendar: DataFrame) -> None:
    row = calendar_violations(calendar).first()
    broken = [k for k, n in row.asDict().items() if n]
    if broken:
        raise ValueError(f"release calendar is invalid: {', '.join(broken)}")


def monthly_gaps(df: DataFrame, series: str, month: str) -> DataFrame:
    """Months missing between the first and last observation of each series."""
    seen = df.select(series, month).distinct()
    following = F.lead(month).over(ordered([series], month))
    step = F.expr("interval 1 month")
    return (
        seen.withColumn("_next", following)
        .where(F.col("_next") > F.add_months(month, 1))
        .select(
            series,
            F.explode(
                F.sequence(F.add_months(month, 1), F.add_months("_next", -1), step)
            ).alias("missing_month"),
        )
    )


# --- snapshots for many cutoffs ---------------------------------------------------


def _one_per_instant(vintages: DataFrame) -> DataFrame:
    known = with_availability(vintages).select(*CELL, AVAILABLE, "realtime_start", "value")
    return latest(known, [*CELL, AVAILABLE], ["realtime_start"])


def ranked_cells(cells: DataFrame) -> DataFrame:
    """Cells with their place among those of their series, one row per period."""
    return cells.withColumn("place", F.row_number().over(ordered(["series_id"], "observation_date")))


def _recent_cells(
    cells: DataFrame, points: DataFrame, mode: str, limit: str, n: int
) -> DataFrame:
    """Each point with its n latest cells up to its limit that were eligible at its as-of time."""
    ranked = ranked_cells(cells)
    upto = ranked.withColumnRenamed("place", "upto")
    moment = F.col("as_of_timestamp") + F.expr("interval 0.000001 seconds")
    if mode == NAIVE:
        moment = F.lit("9999-12-31").cast("timestamp_ntz")
    by = ["series_id"]
    asked = asof_backward(points, upto, limit, "observation_date", ["upto"], by)
    asked = asked.withColumn("before", moment)
    starts = ranked.select(*by, "place", F.col("eligibility_timestamp").alias("start"))
    found = newest_before(asked, starts, by, n)
    return (
        asked.join(found, [*by, "upto", "before"])
        .withColumn("place", F.explode("found"))
        .drop("upto", "before", "found")
        .join(ranked, [*by, "place"])
        .drop("place")
    )


def snapshots(
    vintages: DataFrame,
    points: DataFrame,
    mode: str = AS_OF,
    period_limit: str | None = None,
    recent: int | None = None,
) -> DataFrame:
    """The snapshot of a series at every cutoff, all cutoffs at once.

    `points` holds (series_id, as_of_timestamp, ...) and may hold a latest period wanted.
    The result has one row per point and cell in its information set. The only join that
    multiplies rows is the one that makes these result rows; the vintages are matched to them
    by an as-of merge within the cell. `recent` = n keeps each point's n latest cells up to its
    period limit; only these are ever built.
    """
    versions = _one_per_instant(vintages)
    cells = versions.groupBy(*CELL).agg(
        F.min(AVAILABLE).alias("eligibility_timestamp"),
        F.max_by(F.struct("value", AVAILABLE), F.struct(AVAILABLE, "realtime_start")).alias("_z"),
    )
    if recent is None:
        wanted = cells.join(points, "series_id")
        if mode != NAIVE:
            wanted = wanted.where(F.col("eligibility_timestamp") <= F.col("as_of_timestamp"))
        if period_limit is not None:
            wanted = wanted.where(F.col("observation_date") <= F.col(period_limit))
    else:
        wanted = _recent_cells(cells, points, mode, period_limit, recent)
    if mode != AS_OF:
        return wanted.withColumns(
            {
                "value": F.col("_z.value"),
                "selected_availability": F.col(f"_z.{AVAILABLE}"),
            }
        ).drop("_z")
    rows = wanted.drop("_z", "eligibility_timestamp")
    marks = versions.withColumn("selected_availability", F.col(AVAILABLE))
    hit = asof_backward(
        rows, marks, "as_of_timestamp", AVAILABLE, ["value", "selected_availability"], CELL
    )
    return hit.withColumn("eligibility_timestamp", F.col("selected_availability"))


# --- features ---------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureSpec:
    """One feature: a series, its frequency, and how its latest values are turned into a number."""

    name: str
    series_id: str
    frequency: str = "monthly"
    transformation: str = "level"
    aggregation: str = "latest"
    lag_periods: int = 0
    window: int | None = None


def _spec_rows(origins: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """origins x specs; the specs are literals in the plan."""
    literal = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("feature_name"),
                F.lit(s.series_id).alias("series_id"),
                F.lit(s.frequency).alias("frequency"),
                F.lit(s.transformation).alias("transformation"),
                F.lit(s.aggregation).alias("aggregation"),
                F.lit(s.lag_periods).alias("lag_periods"),
                F.lit(s.window or 1).alias("window_rows"),
            )
            for s in specs
        ]
    )
    return origins.withColumn("_spec", F.explode(literal)).select(*origins.columns, "_spec.*")


def _period_cutoff() -> Column:
    """Last source period an origin may use; ragged-edge series end at the origin's date."""
    period, lag = F.col("target_period"), F.col("lag_periods")
    quarterly_target = F.col("target_frequency") == "quarterly"
    anchor = F.when(quarterly_target, F.add_months(period, 2)).otherwise(period)
    quarter = F.trunc(period, "quarter")
    return (
        F.when(F.col("frequency") == "monthly", F.add_months(anchor, -lag))
        .when(F.col("frequency") == "quarterly", F.add_months(quarter, -3 * lag))
        .otherwise(F.to_date("as_of_timestamp"))
    )


def feature_matrix(
    vintages: DataFrame,
    origins: DataFrame,
    specs: Sequence[FeatureSpec],
    mode: str = AS_OF,
) -> DataFrame:
    """Audited mixed-frequency feature cells for every origin.

    `origins` has forecast_id, target_series_id, target_period, target_frequency and
    as_of_timestamp. Values are chosen by vintage first and transformed afterwards.
    """
    keys = ["forecast_id", "feature_name"]
    plan = _spec_rows(origins, specs).withColumn("source_period_cutoff", _period_cutoff())
    # two cells for a change, three months for a quarter, or a window's
    depth = max(3, *[s.window or 1 for s in specs])
    rows = snapshots(vintages, plan, mode, "source_period_cutoff", depth)
    by_recency = ordered(keys, F.desc("observation_date"))
    recent = rows.withColumn("_rank", F.row_number().over(by_recency))
    d, cutoff = F.col("observation_date"), F.col("source_period_cutoff")
    monthly = F.col("frequency") == "monthly"
    quarterly = F.col("frequency") == "quarterly"
    wide_target = F.col("target_frequency") == "quarterly"
    span = F.when(monthly & wide_target, 3).otherwise(1)
    in_period = F.when(monthly, d >= F.add_months(cutoff, -(span - 1))).when(quarterly, d == cutoff)

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col(column)))

    facts = recent.groupBy(*keys).agg(
        at(1, "value").alias("_cur"),
        at(2, "value").alias("_prev"),
        at(1, "observation_date").alias("latest_source_observation_date"),
        at(2, "observation_date").alias("_prev_date"),
        *[
            at(i, c).alias(f"_{c}_{i}")
            for i in (1, 2)
            for c in ("selected_availability", "eligibility_timestamp")
        ],
        F.max(F.when(F.col("_rank") <= F.col("window_rows"), F.col("selected_availability"))).alias(
            "_win_selected"
        ),
        F.max(F.when(F.col("_rank") <= F.col("window_rows"), F.col("eligibility_timestamp"))).alias(
            "_win_eligible"
        ),
        F.avg(F.when(F.col("_rank") <= F.col("window_rows"), F.col("value"))).alias("_win_mean"),
        F.count(F.when(F.col("_rank") <= F.col("window_rows"), F.col("value"))).alias("_win_known"),
        F.count_if(F.col("_rank") <= F.col("window_rows")).alias("_win_rows"),
        F.count_if(in_period).alias("_in_period"),
    )
    out = plan.join(facts, keys, "left")
    native = F.col("frequency").isin("monthly", "quarterly")
    trailing = ~native & (F.col("aggregation") == "trailing_mean")
    gap = F.when(quarterly, 3).otherwise(1)
    level = F.col("transformation") == "level"
    adjacent = F.col("_prev_date") == F.add_months("latest_source_observation_date", -gap)
    use_prev = F.col("_prev_date").isNotNull() & F.when(native, ~level & adjacent).otherwise(True)
    cur = F.col("_cur")
    prev = F.when(use_prev, F.col("_prev"))
    kinds = sorted({s.transformation for s in specs})
    transformed = reduce(
        lambda acc, k: acc.when(F.col("transformation") == k, transform(cur, prev, k)), kinds, F
    )
    value = F.when(trailing, F.col("_win_mean")).otherwise(transformed)
    found = F.col("latest_source_observation_date").isNotNull()
    point_rows = F.when(use_prev, 2).when(found, 1).otherwise(0)
    point_known = cur.isNotNull().cast("int") + (use_prev & F.col("_prev").isNotNull()).cast("int")

    def newest(prefix: str, window: str) -> Column:
        pair = F.when(use_prev, F.greatest(f"_{prefix}_1", f"_{prefix}_2")).otherwise(
            F.col(f"_{prefix}_1")
        )
        return F.when(trailing, F.col(window)).otherwise(pair)

    n_rows = F.when(trailing, F.coalesce("_win_rows", F.lit(0))).otherwise(point_rows)
    months_late = F.months_between(
        F.trunc("source_period_cutoff", "month"), F.trunc("latest_source_observation_date", "month")
    ).cast("int")
    staleness = (
        F.when(monthly, months_late)
        .when(quarterly, F.floor(months_late / 3).cast("int"))
        .otherwise(F.datediff("source_period_cutoff", "latest_source_observation_date"))
    )
    expected = F.when(native, F.when(monthly, span).otherwise(1)).otherwise(F.col("window_rows"))
    observed = F.when(native, F.coalesce("_in_period", F.lit(0))).otherwise(
        F.least(n_rows, expected)
    )
    return out.select(
        "forecast_id",
        "target_series_id",
        "target_period",
        "target_frequency",
        "as_of_timestamp",
        "feature_name",
        F.col("series_id").alias("source_series_id"),
        value.alias("value"),
        "transformation",
        "aggregation",
        F.lit(mode).alias("information_set_mode"),
        F.lit(mode != AS_OF).alias("is_counterfactual"),
        newest("selected_availability", "_win_selected").alias("max_source_availability"),
        newest("eligibility_timestamp", "_win_eligible").alias("max_eligibility_availability"),
        "source_period_cutoff",
        "latest_source_observation_date",
        F.greatest(staleness, F.lit(0)).cast("bigint").alias("source_staleness_periods"),
        (found & (F.col("latest_source_observation_date") < F.col("source_period_cutoff"))).alias(
            "is_partial_period"
        ),
        observed.cast("bigint").alias("period_observation_count"),
        expected.cast("bigint").alias("expected_period_observation_count"),
        (observed / expected).alias("coverage_ratio"),
        n_rows.cast("bigint").alias("source_observation_count"),
        F.when(trailing, F.coalesce("_win_known", F.lit(0)))
        .otherwise(point_known)
        .cast("bigint")
        .alias("non_null_source_observation_count"),
        value.isNull().alias("is_missing"),
    )


FEATURE_INDEX = (
    "forecast_id",
    "target_series_id",
    "target_period",
    "target_frequency",
    "as_of_timestamp",
    "information_set_mode",
    "is_counterfactual",
)


def wide_features(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per forecast with a column per feature and an audit roll-up."""
    values = [F.first(F.when(F.col("feature_name") == n, F.col("value")), True).alias(n) for n in names]
    return features.groupBy(*FEATURE_INDEX).agg(
        *values,
        F.max("max_source_availability").alias("max_source_availability_ts"),
        F.max("max_eligibility_availability").alias("max_eligibility_availability_ts"),
        F.count_if("is_missing").alias("missing_feature_count"),
        F.count_if("is_partial_period").alias("partial_feature_count"),
        F.avg("coverage_ratio").alias("mean_feature_coverage_ratio"),
    )


def leakage_audit(features: DataFrame) -> DataFrame:
    """Cells selected, or first eligible, after their forecast origin."""
    origin = F.col("as_of_timestamp")
    purpose = (
        F.when(F.col("information_set_mode") == AS_OF, "valid historical information set")
        .when(
            F.col("information_set_mode") == SAME_MASK,
            "value-revision counterfactual with historical eligibility mask",
        )
        .otherwise("intentionally leaky naive latest-revised benchmark")
    )
    return (
        features.groupBy("target_series_id", "information_set_mode")
        .agg(
            F.count(F.lit(1)).alias("feature_cells"),
            F.count_if(F.col("max_source_availability") > origin).alias(
                "selected_vintage_after_origin_cells"
            ),
            F.count_if(F.col("max_eligibility_availability") > origin).alias(
                "first_eligibility_after_origin_cells"
            ),
            F.count_if("is_missing").alias("missing_feature_cells"),
        )
        .withColumn("valid_real_time_information_set", F.col("information_set_mode") == AS_OF)
        .withColumn("research_purpose", purpose)
    )


# --- targets ----------------------------------------------------------------------


def targets(
    vintages: DataFrame,
    releases: DataFrame,
    latest_as_of: str,
    kind: str = "difference",
    step_months: int = 1,
) -> DataFrame:
    """First-release and fixed-cutoff realisations of a target.

    `releases` has series_id, observation_date and release_timestamp of initial releases. The
    two levels of a change always come from one snapshot: the one at the release, or the one
    at the fixed cutoff. Releases after the cutoff are left out.
    """
    cutoff = _cutoff(latest_as_of)
    due = releases.where(F.col("release_timestamp") <= cutoff)
    first = due.select(
        "series_id",
        F.col("observation_date").alias("target_period"),
        F.col("release_timestamp").alias("target_release_timestamp"),
        F.explode(
            F.array(
                F.struct(F.lit("first_release").alias("m"), F.col("release_timestamp").alias("t")),
                F.struct(F.lit("latest_revised").alias("m"), cutoff.alias("t")),
            )
        ).alias("_s"),
    ).select("*", F.col("_s.m").alias("realization_mode"), F.col("_s.t").alias("as_of_timestamp"))
    legs = first.drop("_s").withColumn(
        "leg", F.explode(F.array(F.lit("current"), F.lit("prior")))
    )
    lag = F.when(F.col("leg") == "prior", -step_months).otherwise(0)
    cells = legs.withColumn("observation_date", F.add_months("target_period", lag))
    versions = _one_per_instant(vintages).withColumn("availability", F.col(AVAILABLE))
    hit = asof_backward(
        cells, versions, "as_of_timestamp", AVAILABLE, ["value", "availability"], CELL
    )

    def leg(name: str, column: str) -> Column:
        return F.max(F.when(F.col("leg") == name, F.col(column)))

    keys = ["series_id", "target_period", "realization_mode", "target_release_timestamp"]
    wide = hit.groupBy(*keys, "as_of_timestamp").agg(
        leg("current", "value").alias("current_level"),
        leg("prior", "value").alias("prior_level"),
        leg("current", "availability").alias("current_level_availability"),
        leg("prior", "availability").alias("prior_level_availability"),
    )
    value = transform(F.col("current_level"), F.col("prior_level"), kind)
    return (
        wide.withColumn("value", value)
        .where(F.col("value").isNotNull())
        .withColumnRenamed("series_id", "target_series_id")
        .withColumnRenamed("as_of_timestamp", "snapshot_timestamp")
    )


def research_dataset(
    wide: DataFrame, target_rows: DataFrame, data_mode: str, target_mode: str
) -> DataFrame:
    """Features joined to the realised target of one mode."""
    realised = target_rows.where(F.col("realization_mode") == target_mode).select(
        "target_series_id",
        "target_period",
        F.col("value").alias("target_value"),
        "target_release_timestamp",
        "realization_mode",
    )
    return wide.join(realised, ["target_series_id", "target_period"]).withColumn(
        "data_mode", F.lit(data_mode)
    )


def revision_effects(target_rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """How revisions of the target change the measured forecast error, per model."""
    keys = ["target_series_id", "target_period"]

    def mode(name: str) -> Column:
        return F.first(F.when(F.col("realization_mode") == name, F.col("value")), True)

    revised = (
        target_rows.groupBy(*keys)
        .agg(
            mode("first_release").alias("first_release"),
            mode("latest_revised").alias("latest_revised"),
        )
        .dropna(subset=["first_release", "latest_revised"])
    )
    first_err = F.abs(F.col("prediction") - F.col("first_release"))
    last_err = F.abs(F.col("prediction") - F.col("latest_revised"))
    change = F.col("latest_revised") - F.col("first_release")
    return (
        predictions.join(revised, keys)
        .groupBy("target_series_id", "model_id")
        .agg(
            F.count(F.lit(1)).alias("n_forecasts"),
            F.avg(first_err).alias("mae_first_release"),
            F.avg(last_err).alias("mae_latest_revised"),
            F.avg(change).alias("mean_target_revision"),
            F.avg(F.abs(change)).alias("mean_abs_target_revision"),
            F.avg(last_err - first_err).alias("mean_change_in_absolute_error"),
        )
    )


# --- audits of two runs -----------------------------------------------------------


def timing_audit(
    exact_origins: DataFrame,
    dated_origins: DataFrame,
    exact_features: DataFrame,
    dated_features: DataFrame,
) -> DataFrame:
    """Exact-clock origins against the date-only counterfactual, per target period."""
    keys = ["target_series_id", "target_period"]
    cell = [*keys, "feature_name", "information_set_mode"]
    fields = [
        "is_missing",
        "latest_source_observation_date",
        "max_source_availability",
        "max_eligibility_availability",
        "source_observation_count",
        "non_null_source_observation_count",
        "coverage_ratio",
    ]
    other = dated_features.select(*cell, *[F.col(c).alias(f"_o_{c}") for c in ["value", *fields]])

    def differs(c: str) -> Column:
        return ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))

    moved = reduce(lambda a, b: a | b, [differs(c) for c in fields])
    delta = (
        exact_features.join(other, cell)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("feature_cells_compared"),
            F.count_if(differs("value")).alias("changed_feature_value_cells"),
            F.count_if(moved).alias("changed_feature_selection_cells"),
        )
    )
    a = exact_origins.select(*keys, F.col("forecast_origin").alias("evidence_based_origin"))
    b = dated_origins.select(*keys, F.col("forecast_origin").alias("date_only_origin"))
    shift = F.unix_micros(F.col("evidence_based_origin").cast("timestamp")) - F.unix_micros(
        F.col("date_only_origin").cast("timestamp")
    )
    return (
        a.join(b, keys)
        .join(delta, keys, "left")
        .withColumn("origin_shift_microseconds", shift)
    )


def news_attribution(previous: DataFrame, updated: DataFrame, coefs: DataFrame) -> DataFrame:
    """Contribution of each feature's news to the change of a frozen linear forecast.

    Inputs are long (forecast_id, feature_name, value); `coefs` is (feature_name, coef). The
    residual compares the summed contributions with the change of the prediction itself.
    """
    keys = ["forecast_id", "feature_name"]
    both = previous.select(*keys, F.col("value").alias("previous_value")).join(
        updated.select(*keys, F.col("value").alias("updated_value")), keys
    )
    cells = both.join(coefs, "feature_name").withColumns(
        {
            "feature_change": F.col("updated_value") - F.col("previous_value"),
            "contribution": F.col("coef") * (F.col("updated_value") - F.col("previous_value")),
        }
    )
    totals = cells.groupBy("forecast_id").agg(
        (
            F.sum(F.col("coef") * F.col("updated_value"))
            - F.sum(F.col("coef") * F.col("previous_value"))
        ).alias("total_change"),
        F.sum("contribution").alias("_sum"),
    )
    return (
        cells.join(totals, "forecast_id")
        .withColumn("unattributed_residual", F.col("total_change") - F.col("_sum"))
        .drop("_sum")
    )


def reconcile(derived: DataFrame, published: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """A derived series against its published value; both sides must have the key."""
    other = published.select(*keys, F.col("value").alias("published_value"))
    gap = F.abs(F.col("value") - F.col("published_value"))
    return derived.join(other, list(keys)).withColumns(
        {"absolute_difference": gap, "within_tolerance": gap <= tol}
    )


def update_percentile(movements: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Latest movement of a forecast path as a percentile of its own history."""
    step = F.abs(F.col(value) - F.lag(value).over(ordered(keys, order)))
    steps = movements.withColumn("movement", step).where(F.col("movement").isNotNull())
    last = steps.groupBy(*keys).agg(F.max_by("movement", order).alias("latest_movement"))
    return (
        steps.join(last, list(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_comparisons"),
            (
                100.0
                * ratio(
                    F.count_if(F.col("movement") <= F.col("latest_movement")), F.count(F.lit(1))
                )
            ).alias("percentile"),
            F.percentile("movement", 0.5).alias("median_absolute_movement"),
        )
    )
