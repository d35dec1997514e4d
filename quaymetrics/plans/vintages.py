"""Queries over bitemporal series."""

from pyspark.sql import functions as F

from quaymetrics.core import ordered
from quaymetrics.operators import updates as UP
from quaymetrics.operators import vintage as VT
from quaymetrics.registry import cte, query

CUT = "1998-06-15 12:00:00"
LATE = "2000-06-15 12:00:00"
EOD = "cast(availability_date as timestamp) + interval 1 day - interval 1 microsecond"

cte("known", f"select *, {EOD} as effective_availability from vintages")
cte(
    "cell_latest",
    """
select * exclude (rn), effective_availability as selected_vintage_availability_timestamp from (
  select *, min(effective_availability) over (partition by series_id, observation_date) as eligibility_timestamp,
         row_number() over (partition by series_id, observation_date order by effective_availability desc, realtime_start desc) as rn from known) k where rn = 1
""",
)
SNAP = "series_id, observation_date, realtime_start, value, eligibility_timestamp, selected_vintage_availability_timestamp, is_counterfactual"


@query(
    "V01_as_of",
    f"""
select series_id, observation_date, realtime_start, value, effective_availability as eligibility_timestamp, effective_availability as selected_vintage_availability_timestamp, false as is_counterfactual
from (select *, row_number() over (partition by series_id, observation_date order by effective_availability desc, realtime_start desc) as rn from known where effective_availability <= timestamp '{CUT}') k where rn = 1
""",
)
def _(v):
    return VT.as_of(v.vintages, CUT).select(*SNAP.split(", "))


@query(
    "V02_latest_same_mask",
    f"select {SNAP.replace('is_counterfactual', 'true as is_counterfactual')} from cell_latest where eligibility_timestamp <= timestamp '{CUT}'",
)
def _(v):
    return VT.latest_same_mask(v.vintages, CUT).select(*SNAP.split(", "))


@query("V03_naive_latest", f"select {SNAP.replace('is_counterfactual', 'true as is_counterfactual')} from cell_latest")
def _(v):
    return VT.naive_latest(v.vintages, CUT).select(*SNAP.split(", "))


@query(
    "V04_future_violations",
    f"""
select 'as_of' as mode, count(distinct (series_id, observation_date)) as rows_checked, 0 as future_rows, 0 as counterfactual_rows from known where effective_availability <= timestamp '{CUT}'
union all
select 'naive', count(*), count(*) filter (where effective_availability > timestamp '{CUT}'), count(*) from cell_latest
""",
)
def _(v):
    a = VT.future_violations(VT.as_of(v.vintages, CUT)).withColumn("mode", F.lit("as_of"))
    b = VT.future_violations(VT.naive_latest(v.vintages, CUT)).withColumn("mode", F.lit("naive"))
    return a.unionByName(b)


@query(
    "V04_duplicate_vintages",
    "select series_id, observation_date, realtime_start, count(*) as copies from (select * from vintages union all select * from vintages where day(realtime_start) = 5) v group by 1, 2, 3 having count(*) > 1",
)
def _(v):
    again = v.vintages.where(F.day("realtime_start") == 5)
    return VT.check_vintages(v.vintages.unionByName(again))


cte(
    "first_last",
    """
select series_id, observation_date, max(case when a = 1 then value end) as first_value, max(case when z = 1 then value end) as latest_value,
       min(availability_date) as first_availability, max(availability_date) as latest_availability, count(*) as vintage_count
from (select *, row_number() over (partition by series_id, observation_date order by availability_date, realtime_start) as a,
             row_number() over (partition by series_id, observation_date order by availability_date desc, realtime_start desc) as z from vintages) r group by 1, 2
""",
)


@query(
    "V05_revision_details",
    "select *, latest_value - first_value as revision, abs(latest_value - first_value) as absolute_revision from first_last",
    "first_value:2 latest_value:2 revision:2 absolute_revision:2",
)
def _(v):
    return VT.revision_details(v.vintages)


@query(
    "V05_revision_summary",
    """
with r as (select *, latest_value - first_value as d from first_last where first_value is not null and latest_value is not null)
select series_id, count(*) as observation_count, count(*) filter (where abs(d) > 0) as revision_count, avg(d) as mean_revision, avg(abs(d)) as mean_abs_revision, max(abs(d)) as max_abs_revision from r group by 1
""",
    "mean_revision:3 mean_abs_revision:3 max_abs_revision:2",
)
def _(v):
    return VT.revision_summary(v.vintages)


@query(
    "W03_release_events",
    """
select series_id || '-' || cast(observation_date as varchar) || '-v' || cast(n as varchar) as release_id, series_id, observation_date, availability_date as release_date,
       case when n = 1 then 'initial' else 'revision' end as release_type, n as revision_number
from (select *, row_number() over (partition by series_id, observation_date order by availability_date, realtime_start) as n from vintages) r
""",
)
def _(v):
    return VT.release_events(v.vintages)


@query("W04_latest", "select series_id, observation_date, realtime_start, value from cell_latest")
def _(v):
    known = VT.with_availability(v.vintages)
    out = VT.latest(known, VT.CELL, [VT.AVAILABLE, "realtime_start"])
    return out.select("series_id", "observation_date", "realtime_start", "value")


@query(
    "W05_realtime_ends",
    "select series_id, observation_date, realtime_start, cast(lead(realtime_start) over (partition by series_id, observation_date order by realtime_start) - interval 1 day as date) as realtime_end from vintages",
)
def _(v):
    return VT.realtime_ends(v.vintages).select(
        "series_id", "observation_date", "realtime_start", "realtime_end"
    )


@query(
    "W09_trailing_mean",
    """
select series_id, observation_date, value, avg(value) over (partition by series_id order by observation_date rows between 3 preceding and current row) as trailing_mean
from cell_latest
""",
    "value:2 trailing_mean:3",
)
def _(v):
    from quaymetrics.operators.windows import trailing_mean

    latest = VT.latest_per_cell(VT.with_availability(v.vintages))
    return trailing_mean(
        latest.select("series_id", "observation_date", "value"),
        ["series_id"],
        "observation_date",
        "value",
        4,
        "trailing_mean",
    )


# --- calendars --------------------------------------------------------------------


def calendar(v):
    events = VT.release_events(v.vintages)
    return events.withColumn(
        "release_timestamp", F.col("release_date").cast("timestamp_ntz") + F.expr("interval 13 hours")
    )


@query(
    "V12_calendar_violations",
    """
with e as (select series_id, observation_date, availability_date, row_number() over (partition by series_id, observation_date order by availability_date, realtime_start) as n from vintages)
select 0 as null_release, 0 as duplicate_ids, 0 as extra_initial_releases, count(*) filter (where availability_date <= observation_date) as released_before_period from e
""",
)
def _(v):
    return VT.calendar_violations(calendar(v))


@query(
    "V15_monthly_gaps",
    """
with m as (select distinct o_custkey as series, cast(date_trunc('month', o_orderdate) as date) as month from orders),
g as (select series, cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as missing_month from m group by series)
select g.series, g.missing_month from g left join m on g.series = m.series and g.missing_month = m.month where m.month is null
""",
)
def _(v):
    rows = v.orders.select(
        F.col("o_custkey").alias("series"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"),
    )
    return VT.monthly_gaps(rows, "series", "month")


# --- snapshots and features -------------------------------------------------------

# Origins: one second before each initial release becomes available.
cte(
    "origins",
    """
select series_id || ':' || cast(observation_date as varchar) as forecast_id, series_id as target_series_id, observation_date as target_period, 'monthly' as target_frequency,
       min(effective_availability) - interval 1 second as as_of_timestamp, min(effective_availability) as release_timestamp from known group by series_id, observation_date
""",
)


def releases(v):
    known = VT.with_availability(v.vintages)
    return known.groupBy(*VT.CELL).agg(F.min(VT.AVAILABLE).alias("release_timestamp"))


def origins(v):
    return releases(v).select(
        F.concat_ws(":", "series_id", F.col("observation_date").cast("string")).alias("forecast_id"),
        F.col("series_id").alias("target_series_id"),
        F.col("observation_date").alias("target_period"),
        F.lit("monthly").alias("target_frequency"),
        (F.col("release_timestamp") - F.expr("interval 1 second")).alias("as_of_timestamp"),
        "release_timestamp",
    )


@query(
    "J06_snapshots",
    """
with o as (select distinct target_series_id as series_id, as_of_timestamp from origins),
c as (select series_id, observation_date, min(effective_availability) as first_at from known group by 1, 2)
select c.series_id, c.observation_date, o.as_of_timestamp, k.value, k.effective_availability as selected_availability
from c join o on c.series_id = o.series_id and c.first_at <= o.as_of_timestamp
asof join known k on k.series_id = c.series_id and k.observation_date = c.observation_date and o.as_of_timestamp >= k.effective_availability
""",
)
def _(v):
    points = origins(v).select(
        F.col("target_series_id").alias("series_id"), "as_of_timestamp"
    ).distinct()
    return VT.snapshots(v.vintages, points).drop("eligibility_timestamp")


SPECS = (
    VT.FeatureSpec("urgent_level", "1-URGENT", "monthly", "level", "latest", 1),
    VT.FeatureSpec("high_change", "2-HIGH", "monthly", "percent_change", "latest", 1),
    VT.FeatureSpec("medium_trailing", "3-MEDIUM", "daily", "level", "trailing_mean", 0, 3),
    VT.FeatureSpec("low_quarter", "5-LOW", "quarterly", "log_change", "latest", 1),
)


def quarterly_vintages(v):
    """The low-priority series at quarter starts only, as a quarterly source."""
    keep = (F.col("series_id") != "5-LOW") | F.month("observation_date").isin(1, 4, 7, 10)
    return v.vintages.where(keep)


FEATURE_ROWS = """
with spec as (select * from (values ('urgent_level', '1-URGENT', 'monthly', 'level', 'latest', 1, 1), ('high_change', '2-HIGH', 'monthly', 'percent_change', 'latest', 1, 1),
   ('medium_trailing', '3-MEDIUM', 'daily', 'level', 'trailing_mean', 0, 3), ('low_quarter', '5-LOW', 'quarterly', 'log_change', 'latest', 1, 1)) s(feature_name, series_id, frequency, transformation, aggregation, lag_periods, n)),
kn as (select * from known where series_id <> '5-LOW' or month(observation_date) in (1, 4, 7, 10)),
p as (select o.*, s.*, case when frequency = 'monthly' then cast(target_period - interval 1 month as date)
             when frequency = 'quarterly' then cast(date_trunc('quarter', target_period) - interval 3 month as date) else cast(as_of_timestamp as date) end as source_period_cutoff from {origins} o, spec s),
c as (select series_id, observation_date, min(effective_availability) as first_at, arg_max(coalesce(value, -1), effective_availability) as last_raw, max(effective_availability) as last_at from kn group by 1, 2),
pc as (select p.*, c.observation_date, c.first_at, nullif(c.last_raw, -1) as last_value, c.last_at from p join c on p.series_id = c.series_id and c.observation_date <= p.source_period_cutoff),
s as ({snap}),
r as (select *, row_number() over (partition by forecast_id, feature_name order by observation_date desc) as rk from s),
f as (select forecast_id, feature_name, max(case when rk = 1 then value end) as cur, max(case when rk = 2 then value end) as prev, max(case when rk = 1 then observation_date end) as d1,
       max(case when rk = 2 then observation_date end) as d2, max(case when rk = 1 then sel end) as s1, max(case when rk = 2 then sel end) as s2, max(case when rk = 1 then elig end) as e1,
       max(case when rk = 2 then elig end) as e2, avg(case when rk <= n then value end) as wm, max(case when rk <= n then sel end) as ws, max(case when rk <= n then elig end) as we,
       count(*) filter (where rk <= n) as wn, count(case when rk <= n then value end) as wk, count(*) filter (where observation_date = source_period_cutoff) as inp from r group by 1, 2),
j as (select p.*, f.* exclude (forecast_id, feature_name), case frequency when 'daily' then d2 is not null when 'monthly' then transformation <> 'level' and d2 = cast(d1 - interval 1 month as date)
       else d2 = cast(d1 - interval 3 month as date) end as up from p left join f on p.forecast_id = f.forecast_id and p.feature_name = f.feature_name),
v as (select *, case when aggregation = 'trailing_mean' then wm when transformation = 'level' then cur when not coalesce(up, false) then null
       when transformation = 'percent_change' then (cur / nullif(prev, 0) - 1) * 100 else (ln(cur) - ln(prev)) * 100 end as val from j)
select forecast_id, target_series_id, target_period, as_of_timestamp, feature_name, series_id as source_series_id, val as value, '{mode}' as information_set_mode,
       case when aggregation = 'trailing_mean' then ws when coalesce(up, false) then greatest(s1, s2) else s1 end as max_source_availability,
       case when aggregation = 'trailing_mean' then we when coalesce(up, false) then greatest(e1, e2) else e1 end as max_eligibility_availability, source_period_cutoff, d1 as latest_source_observation_date,
       cast(greatest(case frequency when 'monthly' then datediff('month', d1, source_period_cutoff) when 'quarterly' then datediff('month', d1, source_period_cutoff) // 3 else datediff('day', d1, source_period_cutoff) end, 0) as bigint) as source_staleness_periods,
       d1 is not null and d1 < source_period_cutoff as is_partial_period, case when frequency = 'daily' then coalesce(wn, 0) / 3.0::double else coalesce(inp, 0) / 1.0::double end as coverage_ratio,
       case when aggregation = 'trailing_mean' then coalesce(wn, 0) when d1 is null then 0 when coalesce(up, false) then 2 else 1 end as source_observation_count,
       case when aggregation = 'trailing_mean' then coalesce(wk, 0) else cast(cur is not null as bigint) + cast(coalesce(up, false) and prev is not null as bigint) end as non_null_source_observation_count,
       val is null as is_missing, transformation, aggregation, {cf} as is_counterfactual, target_frequency
from v
"""
AS_OF_SNAP = """select pc.*, k.value, k.effective_availability as sel, k.effective_availability as elig from pc
   asof join kn k on k.series_id = pc.series_id and k.observation_date = pc.observation_date and pc.as_of_timestamp >= k.effective_availability where pc.first_at <= pc.as_of_timestamp"""
MASK_SNAP = "select *, last_value as value, last_at as sel, first_at as elig from pc where first_at <= as_of_timestamp"
NAIVE_SNAP = "select *, last_value as value, last_at as sel, first_at as elig from pc"


def feature_sql(snap, mode, cf, source="origins"):
    return FEATURE_ROWS.format(snap=snap, mode=mode, cf=cf, origins=source)


cte("features_as_of", feature_sql(AS_OF_SNAP, VT.AS_OF, "false"))
cte("features_mask", feature_sql(MASK_SNAP, VT.SAME_MASK, "true"))
cte("features_naive", feature_sql(NAIVE_SNAP, VT.NAIVE, "true"))
FEATURE_COLUMNS = (
    "forecast_id, target_series_id, target_period, as_of_timestamp, feature_name, source_series_id, value, information_set_mode, max_source_availability, max_eligibility_availability, "
    "source_period_cutoff, latest_source_observation_date, source_staleness_periods, is_partial_period, coverage_ratio, source_observation_count, non_null_source_observation_count, is_missing"
)


def features(v, mode=VT.AS_OF, points=None):
    return VT.feature_matrix(quarterly_vintages(v), points or origins(v), SPECS, mode)


for _mode, _table in (
    (VT.AS_OF, "features_as_of"),
    (VT.SAME_MASK, "features_mask"),
    (VT.NAIVE, "features_naive"),
):
    query(
        f"V06_{_table}", f"select {FEATURE_COLUMNS} from {_table}", "value:3 coverage_ratio"
    )(lambda v, m=_mode: features(v, m).select(*FEATURE_COLUMNS.split(", ")))


NAMES = [s.name for s in SPECS]
cte(
    "wide",
    "select forecast_id, target_series_id, target_period, target_frequency, as_of_timestamp, information_set_mode, is_counterfactual, "
    + ", ".join(f"max(case when feature_name = '{n}' then value end) as {n}" for n in NAMES)
    + ", max(max_source_availability) as max_source_availability_ts, max(max_eligibility_availability) as max_eligibility_availability_ts, "
    "count(*) filter (where is_missing) as missing_feature_count, count(*) filter (where is_partial_period) as partial_feature_count, avg(coverage_ratio) as mean_feature_coverage_ratio "
    "from features_as_of group by all",
)


def stored_features(v):
    return v.stored("features_as_of", lambda: features(v))


@query("V07_wide_features", "select * from wide", "urgent_level:2 high_change:3 medium_trailing:3 low_quarter:3 mean_feature_coverage_ratio")
def _(v):
    return VT.wide_features(features(v), NAMES)


@query(
    "V08_leakage_audit",
    """
with f as (select * from features_as_of union all select * from features_mask union all select * from features_naive)
select target_series_id, information_set_mode, count(*) as feature_cells, count(*) filter (where max_source_availability > as_of_timestamp) as selected_vintage_after_origin_cells,
       count(*) filter (where max_eligibility_availability > as_of_timestamp) as first_eligibility_after_origin_cells, count(*) filter (where is_missing) as missing_feature_cells,
       information_set_mode = 'as_of' as valid_real_time_information_set
from f group by 1, 2
""",
)
def _(v):
    every = features(v).unionByName(features(v, VT.SAME_MASK)).unionByName(features(v, VT.NAIVE))
    return VT.leakage_audit(every).drop("research_purpose")


# --- targets ----------------------------------------------------------------------

cte(
    "targets",
    f"""
with r as (select target_series_id as series_id, target_period, release_timestamp from origins where release_timestamp <= timestamp '{LATE}'),
m as (select *, 'first_release' as realization_mode, release_timestamp as t from r union all select *, 'latest_revised', timestamp '{LATE}' from r),
l as (select m.*, 0 as leg, target_period as observation_date from m union all select m.*, 1, cast(target_period - interval 1 month as date) from m),
h as (select l.*, k.value, k.effective_availability as av from l asof left join known k on k.series_id = l.series_id and k.observation_date = l.observation_date and l.t >= k.effective_availability)
select series_id as target_series_id, target_period, realization_mode, release_timestamp as target_release_timestamp, t as snapshot_timestamp, max(case when leg = 0 then value end) as current_level,
       max(case when leg = 1 then value end) as prior_level, max(case when leg = 0 then av end) as current_level_availability, max(case when leg = 1 then av end) as prior_level_availability,
       (max(case when leg = 0 then value end) / nullif(max(case when leg = 1 then value end), 0) - 1) * 100 as value
from h group by series_id, target_period, realization_mode, release_timestamp, t
having (max(case when leg = 0 then value end) / nullif(max(case when leg = 1 then value end), 0) - 1) is not null
""",
)


def target_rows(v):
    return VT.targets(v.vintages, releases(v), LATE, "percent_change")


@query("V09_targets", "select * from targets", "current_level:2 prior_level:2 value:4")
def _(v):
    return target_rows(v)


@query(
    "V10_research_dataset",
    """
select w.*, t.value as target_value, t.target_release_timestamp, t.realization_mode, 'vintage_aware' as data_mode
from wide w join targets t on w.target_series_id = t.target_series_id and w.target_period = t.target_period where t.realization_mode = 'first_release'
""",
    "urgent_level:2 high_change:3 medium_trailing:3 low_quarter:3 mean_feature_coverage_ratio target_value:4",
)
def _(v):
    wide = VT.wide_features(features(v), NAMES)
    return VT.research_dataset(wide, target_rows(v), "vintage_aware", "first_release")


def naive_predictions(v):
    """Two simple predictions per target: nothing changes, and last month's change repeats."""
    first = target_rows(v).where(F.col("realization_mode") == "first_release")
    prior = F.lag("value").over(ordered(["target_series_id"], "target_period"))
    cols = ["target_series_id", "target_period"]
    zero = first.select(*cols, F.lit("zero").alias("model_id"), F.lit(0.0).alias("prediction"))
    lag = first.select(*cols, F.lit("lag1").alias("model_id"), prior.alias("prediction"))
    return zero.unionByName(lag.where(F.col("prediction").isNotNull()))


@query(
    "V11_revision_effects",
    """
with f as (select * from targets where realization_mode = 'first_release'), l as (select * from targets where realization_mode = 'latest_revised'),
p as (select target_series_id, target_period, 'zero' as model_id, 0.0::double as prediction from f union all
      select * from (select target_series_id, target_period, 'lag1', lag(value) over (partition by target_series_id order by target_period) as pr from f) x where pr is not null),
j as (select p.*, f.value as a, l.value as b from p join f using (target_series_id, target_period) join l using (target_series_id, target_period))
select target_series_id, model_id, count(*) as n_forecasts, avg(abs(prediction - a)) as mae_first_release, avg(abs(prediction - b)) as mae_latest_revised, avg(b - a) as mean_target_revision,
       avg(abs(b - a)) as mean_abs_target_revision, avg(abs(prediction - b) - abs(prediction - a)) as mean_change_in_absolute_error
from j group by 1, 2
""",
    "mae_first_release:4 mae_latest_revised:4 mean_target_revision:4 mean_abs_target_revision:4 mean_change_in_absolute_error:4",
)
def _(v):
    return VT.revision_effects(target_rows(v), naive_predictions(v))


# --- audits -----------------------------------------------------------------------


def dated_origins(v):
    back = F.expr("interval 9 days")
    return origins(v).withColumn("as_of_timestamp", F.col("as_of_timestamp") - back)


cte(
    "dated_origins",
    "select * replace (as_of_timestamp - interval 9 day as as_of_timestamp) from origins",
)
cte("features_dated", feature_sql(AS_OF_SNAP, VT.AS_OF, "false", "dated_origins"))


@query(
    "V13_timing_audit",
    """
with d as (select a.target_series_id, a.target_period, count(*) as feature_cells_compared, count(*) filter (where a.value is distinct from b.value) as changed_feature_value_cells,
  count(*) filter (where a.is_missing is distinct from b.is_missing or a.latest_source_observation_date is distinct from b.latest_source_observation_date or a.max_source_availability is distinct from b.max_source_availability
    or a.max_eligibility_availability is distinct from b.max_eligibility_availability or a.source_observation_count is distinct from b.source_observation_count
    or a.non_null_source_observation_count is distinct from b.non_null_source_observation_count or a.coverage_ratio is distinct from b.coverage_ratio) as changed_feature_selection_cells
  from features_as_of a join features_dated b using (target_series_id, target_period, feature_name) group by 1, 2)
select o.target_series_id, o.target_period, o.as_of_timestamp as evidence_based_origin, x.as_of_timestamp as date_only_origin, feature_cells_compared, changed_feature_value_cells, changed_feature_selection_cells,
       epoch_us(o.as_of_timestamp) - epoch_us(x.as_of_timestamp) as origin_shift_microseconds
from origins o join dated_origins x using (target_series_id, target_period) left join d using (target_series_id, target_period)
""",
)
def _(v):
    exact = origins(v).withColumnRenamed("as_of_timestamp", "forecast_origin")
    dated = dated_origins(v).withColumnRenamed("as_of_timestamp", "forecast_origin")
    return VT.timing_audit(exact, dated, features(v), features(v, points=dated_origins(v)))


COEFS = {"urgent_level": 0.00001, "high_change": 0.5, "medium_trailing": -0.00002, "low_quarter": 0.25}


@query(
    "V14_news_attribution",
    """
with c as (select * from (values ('urgent_level', 0.00001::double), ('high_change', 0.5::double), ('medium_trailing', -0.00002::double), ('low_quarter', 0.25::double)) k(feature_name, coef)),
x as (select forecast_id, feature_name, a.value as previous_value, b.value as updated_value, coef, b.value - a.value as feature_change, coef * (b.value - a.value) as contribution
      from features_dated a join features_as_of b using (forecast_id, feature_name) join c using (feature_name)),
t as (select forecast_id, sum(coef * updated_value) - sum(coef * previous_value) as total_change, sum(contribution) as s from x group by 1)
select x.*, total_change, total_change - s as unattributed_residual from x join t using (forecast_id)
""",
    "previous_value:3 updated_value:3 feature_change:3 contribution:5 total_change:5 unattributed_residual:5 coef:7",
)
def _(v):
    coefs = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(b).alias("b")) for n, b in COEFS.items()]))
    table = v.spark.range(1).select(coefs.alias("c")).select(
        F.col("c.n").alias("feature_name"), F.col("c.b").alias("coef")
    )
    return VT.news_attribution(features(v, points=dated_origins(v)), features(v), table)


@query(
    "Q09_reconcile",
    """
select a.series_id, a.observation_date, a.value, b.v as published_value, abs(a.value - b.v) as absolute_difference, abs(a.value - b.v) <= 100000 as within_tolerance
from cell_latest a join (select o_orderpriority as series_id, cast(date_trunc('month', o_orderdate) as date) as observation_date, sum(l_extendedprice) as v
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) b on a.series_id = b.series_id and a.observation_date = b.observation_date
""",
    "value:2 published_value:2 absolute_difference:2",
)
def _(v):
    derived = VT.latest_per_cell(VT.with_availability(v.vintages)).select(*VT.CELL, "value")
    published = (
        v.lineitem.join(v.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("observation_date"),
        )
        .agg(F.sum("l_extendedprice").alias("value"))
    )
    return VT.reconcile(derived, published, VT.CELL, 100000.0)


# Every release moment before some target of a period, looked at one tick earlier and at the moment.
cte(
    "update_points",
    """
select target_period || '@' || t || '@' || side as forecast_id, '' as target_series_id, target_period, 'monthly' as target_frequency, t as release_timestamp,
       case side when 0 then t - interval 1 microsecond else t end as as_of_timestamp, t, side
from (select target_period, max(release_timestamp) as r from origins group by 1) o
  join (select distinct effective_availability as t from known where series_id in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') and (series_id <> '5-LOW' or month(observation_date) in (1, 4, 7, 10))) d on d.t < o.r, (values (0), (1)) s(side)
""",
)
cte("features_around", feature_sql(AS_OF_SNAP, VT.AS_OF, "false", "update_points"))
cte(
    "last_updates",
    """
with x as (select p.target_period, p.t, f.feature_name, max(case when p.side = 0 then f.value end) as previous_value, max(case when p.side = 1 then f.value end) as updated_value
  from features_around f join update_points p using (forecast_id) group by 1, 2, 3),
ch as (select * from x where (previous_value is null) <> (updated_value is null) or abs(previous_value - updated_value) > 1e-12)
select o.forecast_id, ch.feature_name, max(ch.t) as release_timestamp, arg_max(coalesce(cast(previous_value as varchar), ''), ch.t) as p, arg_max(coalesce(cast(updated_value as varchar), ''), ch.t) as u
from origins o join ch on ch.target_period = o.target_period and ch.t < o.release_timestamp group by 1, 2
""",
)


@query(
    "V16_last_update",
    """
select forecast_id, feature_name, release_timestamp, cast(nullif(p, '') as double) as previous_value, cast(nullif(u, '') as double) as updated_value from last_updates
""",
    "previous_value:3 updated_value:3",
)
def _(v):
    return UP.last_update(quarterly_vintages(v), origins(v), SPECS)


@query(
    "V16_update_event",
    """
with r as (select l.*, o.target_series_id, case feature_name when 'urgent_level' then '1-URGENT' when 'high_change' then '2-HIGH' when 'medium_trailing' then '3-MEDIUM' else '5-LOW' end as s,
  case feature_name when 'medium_trailing' then 2 else 0 end as k from last_updates l join origins o using (forecast_id)),
b as (select *, rank() over (partition by forecast_id order by cast(s = target_series_id as int), k, l.release_timestamp desc) as rn from (select * exclude (release_timestamp), release_timestamp from r) l)
select forecast_id, release_timestamp, count(*) as changed_features, min(feature_name) as first_feature from b where rn = 1 group by 1, 2
""",
)
def _(v):
    updates = UP.last_update(quarterly_vintages(v), origins(v), SPECS)
    return UP.update_event(updates, origins(v), SPECS)


@query(
    "V16_update_percentile",
    """
with p as (select series_id, model_id, period, prediction, abs(prediction - lag(prediction) over (partition by series_id, model_id order by period)) as movement from forecasts),
m as (select * from p where movement is not null), l as (select series_id, model_id, arg_max(movement, period) as last from m group by 1, 2)
select m.series_id, m.model_id, count(*) as n_comparisons, 100.0::double * (count(*) filter (where movement <= last)) / count(*) as percentile, quantile_cont(movement, 0.5) as median_absolute_movement
from m join l on m.series_id = l.series_id and m.model_id = l.model_id group by 1, 2
""",
    "percentile:4 median_absolute_movement:2",
)
def _(v):
    return VT.update_percentile(v.forecasts, ["series_id", "model_id"], "period", "prediction")


