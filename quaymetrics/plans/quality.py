"""Queries for data-quality tables."""

from pyspark.sql import functions as F

from quaymetrics.operators import mobility as MB
from quaymetrics.operators import quality as Q
from quaymetrics.operators import trade as TD
from quaymetrics.operators import trips as TR
from quaymetrics.plans.mobility import flows_view
from quaymetrics.plans.policy import TREATED, panel_view
from quaymetrics.plans.projections import raw_a
from quaymetrics.registry import cte, query

TRIP_COLUMNS = "source zone_type trip_id pickup_datetime dropoff_datetime pickup_zone_id dropoff_zone_id fare tips trip_miles shared_requested shared_matched".split()


@query(
    "Q01_missingness",
    "\nunion all\n".join(
        f'select \'{c}\' as "column", count(*) - count({c}) as nulls, (count(*) - count({c})) / count(*)::double as null_rate from trips'
        for c in TRIP_COLUMNS
    ),
    "null_rate",
)
def _(v):
    return Q.missingness(v.trips.select(*TRIP_COLUMNS))


@query(
    "Q01_trip_diagnostics",
    """
select count(*) as row_count, count(distinct 'chicago_tnp') as sources, count(*) filter (where event_id % 4 = 0) as pickup_suppressed, (count(*) filter (where event_id % 4 = 0)) / count(*)::double as pickup_suppressed_rate,
  'available' as pickup_indicator_status, count(*) as dropoff_suppressed, 'available' as dropoff_indicator_status, (count(*) filter (where minute(ts) % 15 = 0)) / count(*)::double as pickup_on_grid_rate,
  (count(*) filter (where abs(round_even(round(value * 2) / 2 / 2.5, 0) * 2.5 - round(value * 2) / 2) <= 1e-8)) / count(value)::double as fare_on_grid_rate,
  count(event_id) - count(distinct event_id) as duplicate_trip_ids, 0 as missing_trip_ids, 0 as nonpositive_trip_seconds, 0 as negative_trip_miles, count(*) filter (where round(value * 2) / 2 < 0) as negative_fares,
  0 as utc_conversion_nulls from events
""",
    "pickup_suppressed_rate pickup_on_grid_rate fare_on_grid_rate",
)
def _(v):
    return Q.trip_diagnostics(TR.normalize_source_a(raw_a(v)))


@query(
    "Q02_conservation",
    """
select count(*) as clean_rows, 0 as pickup_datetime_null_rows, min(pickup_datetime) as pickup_min, max(pickup_datetime) as pickup_max, (select count(*) from panel15) as zone_rows,
  count(*) as zone_trip_sum, 0 as zone_key_duplicates, 0 as zero_trip_cells,
  (select count(*) from (select distinct coalesce(pickup_zone_id, 'm'), coalesce(dropoff_zone_id, 'm'), time_bucket(interval 15 minute, pickup_datetime) from event_trips) d) as od_rows,
  count(*) as od_trip_sum, 0 as od_key_duplicates, 0 as nonpositive_od_rows, true as conserved from event_trips
""",
)
def _(v):
    trips = v.event_trips
    return Q.conservation(trips, MB.zone_time_panel(trips, 15), MB.od_flow(trips, 15))


@query(
    "Q03_calendar_coverage",
    """
with e as (select ts from events where not (day(ts) = 11) and not (day(ts) = 20 and hour(ts) = 5)),
d as (select cast(unnest(generate_series(date '2024-01-03', date '2024-02-02', interval 1 day)) as date) as service_date),
s as (select distinct cast(ts as date) as service_date, hour(ts) as h from e)
select 'missing_date' as kind, service_date, cast(null as integer) as hour from d where service_date not in (select service_date from s)
union all select 'missing_date_hour', d.service_date, cast(h as integer) from d, range(0, 24) t(h) where (d.service_date, h) not in (select (service_date, h) from s)
union all select distinct 'outside_period', service_date, cast(null as integer) from s where service_date not between date '2024-01-03' and date '2024-02-02'
""",
)
def _(v):
    ts = F.col("ts")
    kept = v.events.where((F.day(ts) != 11) & ~((F.day(ts) == 20) & (F.hour(ts) == 5)))
    return Q.calendar_coverage(kept, "ts", "2024-01-03", "2024-02-02")


cte(
    "uneven_edges",
    """
select focal_zone_id, neighbor_zone_id, case when focal_zone_id = '3' and neighbor_zone_id = '4' then weight + 1 when focal_zone_id = '5' and neighbor_zone_id = '6' then -weight else weight end as weight from edges
union all select focal_zone_id, focal_zone_id, 1.0::double from (select distinct focal_zone_id from edges where focal_zone_id in ('1', '2')) s
union all select focal_zone_id, neighbor_zone_id, weight from edges, range(2) where focal_zone_id in ('3', '7')
""",
)


@query(
    "Q08_edge_checks",
    """
with b as (select e.*, not exists (select 1 from uneven_edges r where e.focal_zone_id = r.neighbor_zone_id and e.neighbor_zone_id = r.focal_zone_id)
    or exists (select 1 from uneven_edges r where e.focal_zone_id = r.neighbor_zone_id and e.neighbor_zone_id = r.focal_zone_id and abs(e.weight - r.weight) > 1e-12) as uneven from uneven_edges e)
select count(*) as edges, count(*) - count(distinct (focal_zone_id, neighbor_zone_id)) as duplicate_pairs, count(*) filter (where focal_zone_id = neighbor_zone_id) as self_edges,
  count(*) filter (where not weight > 0) as nonpositive_weights, count(*) filter (where uneven) as asymmetric_edges, count(distinct focal_zone_id) as focal_zones from b
""",
)
def _(v):
    edges = MB.symmetric_edges(MB.od_edges(flows_view(v)))
    f, n, w = F.col("focal_zone_id"), F.col("neighbor_zone_id"), F.col("weight")
    uneven = (
        F.when((f == "3") & (n == "4"), w + 1).when((f == "5") & (n == "6"), -w).otherwise(w)
    )
    loops = edges.where(f.isin("1", "2")).select(
        f, f.alias("neighbor_zone_id"), F.lit(1.0).alias("weight")
    ).distinct()
    # pairs that stand three times, some of them with two weights
    again = edges.where(f.isin("3", "7"))
    return Q.edge_checks(
        edges.withColumn("weight", uneven).unionByName(loops).unionByName(again).unionByName(again)
    )


@query(
    "Q06_consistency",
    """
with t as (select * from decomposed_totals), g as (select sum(post_value - pre_value) as alt from margins where country_code <> '3')
select 'treated_change' as "check", treated_total as parts, treated_total as whole, true as passed from t union all select 'alternative_change', alternative_total, alternative_total, true from t
union all select 'pre_treated_value', pre_treated_value, pre_treated_value, true from t union all select 'partner_gains', g.alt, alternative_total, true from t, g
""",
    "parts:1 whole:1",
)
def _(v):
    panel = panel_view(v)
    by_product = TD.decompose(panel, TREATED)
    split = TD.split_by_dependence(panel, by_product, TREATED)
    gains = TD.country_gains(panel, TREATED)
    return Q.consistency(split, gains, TD.decompose_totals(by_product))


@query(
    "Q07_trade_checks",
    """
with f as (select hs10, country_code, count(*) as n, count(distinct nullif(quantity_unit, '')) as u, quantile_cont(log_customs_unit_value, 0.5) as med, stddev_samp(log_customs_unit_value) as sd from panel group by 1, 2),
x as (select count(*) filter (where sd > 0 and abs(log_customs_unit_value - med) / sd > 3.0) as n from panel p join f using (hs10, country_code)),
j as (select count(*) filter (where abs(d) > 1.0) as n from (select log_customs_value - lag(log_customs_value) over (partition by hs10, country_code order by month_date) as d from panel) q),
r as (select count(*) as rows, count(*) filter (where country_code not in ('0', '1', '2', '3')) as c, count(*) filter (where customs_value > 0 and coalesce(quantity, 0) <= 0) as z,
  count(*) filter (where realised_duty_rate_on_dutiable is not null and total_modeled_tariff_rate is not null and customs_value > 0 and abs(realised_duty_rate_on_dutiable - total_modeled_tariff_rate) > 0.03) as d,
  count(*) filter (where realised_duty_rate_on_dutiable is not null and total_modeled_tariff_rate is not null and customs_value > 0) as cmp,
  count(*) filter (where coalesce(total_modeled_tariff_rate, 0) > 0 and customs_value > 0 and coalesce(calculated_duties, 0) <= 0) as m, count(*) filter (where not tariff_usable_for_treatment) as a from panel),
g as (select count(*) as flows, count(*) filter (where n < (select count(distinct month_date) from panel)) as gaps, count(*) filter (where u > 1) as uc from f),
t as (select 'DUP_KEY' as check_id, 'ERROR' as severity, 0 as n_flagged, rows as n_total from r union all select 'BAD_COUNTRY', 'ERROR', c, rows from r union all select 'BAD_PRODUCT_CODE', 'ERROR', 0, rows from r
  union all select 'UNIT_CHANGE', 'ERROR', uc, rows from r, g union all select 'NEGATIVE_VALUES', 'ERROR', 0, rows from r union all select 'ZERO_QUANTITY_POSITIVE_VALUE', 'WARN', z, rows from r
  union all select 'EXTREME_UNIT_VALUE', 'WARN', x.n, rows from r, x union all select 'DUTY_VS_ENGINE', 'WARN', d, cmp from r union all select 'MISSING_DUTIES', 'WARN', m, rows from r
  union all select 'TRADE_JUMP', 'INFO', j.n, rows from r, j union all select 'PANEL_GAPS', 'INFO', gaps, flows from g union all select 'TARIFF_AMBIGUOUS', 'WARN', a, rows from r)
select *, n_flagged = 0 as passed from t
""",
)
def _(v):
    return Q.trade_checks(panel_view(v), ["0", "1", "2", "3"], z_cut=3.0, jump=1.0)
