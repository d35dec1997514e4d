"""Queries over trip logs: panels, flows, graphs, profiles, areas and daily signals."""

from pyspark.sql import functions as F

from quaymetrics.operators import areas as AR
from quaymetrics.operators import mobility as M
from quaymetrics.plans.projections import daily_signal
from quaymetrics.registry import cte, query

UNKNOWN = "'__MISSING_OR_OUTSIDE__'"


def panel_sql(minutes: int, src: str, miles: str, matched: str) -> str:
    return f"""
select source, zone_type, coalesce(pickup_zone_id, {UNKNOWN}) as zone_id, time_bucket(interval {minutes} minute, pickup_datetime) as time_bin,
       count(*) as trip_count,
       case when count(*) filter (where od) > 0 then count(distinct case when od then dropoff_zone_id end) end as distinct_dropoff_zones,
       case when count(*) filter (where od) > 0 then count(*) filter (where od and pickup_zone_id <> dropoff_zone_id) end as outbound_trip_count,
       avg(case when od then cast(pickup_zone_id = dropoff_zone_id as double) end) as intra_zone_share,
       count(*) filter (where od) as od_pair_observed_count, avg(cast(od as double)) as od_pair_observed_share,
       avg(fare) as avg_fare, median(fare) as median_fare, sum(fare) as total_fare, avg({miles}) as avg_trip_miles, sum({miles}) as total_trip_miles,
       avg(cast(shared_requested as double)) as shared_requested_share, avg({matched}) as shared_matched_share
from (select *, pickup_zone_id is not null and dropoff_zone_id is not null as od from {src}) t
group by 1, 2, 3, 4
"""


cte("panel15", panel_sql(15, "event_trips", "cast(null as double)", "cast(null as double)"))
cte("panel60", panel_sql(60, "event_trips", "cast(null as double)", "cast(null as double)"))
PANEL_COLUMNS = (
    "source, zone_type, zone_id, time_bin, trip_count, distinct_dropoff_zones, outbound_trip_count, intra_zone_share, "
    "od_pair_observed_count, od_pair_observed_share, avg_fare, median_fare, total_fare, avg_trip_miles, total_trip_miles, "
    "shared_requested_share, shared_matched_share"
)
PANEL_DIGITS = (
    "intra_zone_share od_pair_observed_share avg_fare:4 median_fare:3 total_fare:2 avg_trip_miles:4 total_trip_miles:2 "
    "shared_requested_share shared_matched_share"
)
CALENDAR_SQL = (
    "cast(time_bin as date) as service_date, year(time_bin) as year, month(time_bin) as month, isodow(time_bin) as day_of_week, "
    "hour(time_bin) as hour, minute(time_bin) as minute, isodow(time_bin) >= 6 as is_weekend"
)
CALENDAR = ["service_date", "year", "month", "day_of_week", "hour", "minute", "is_weekend"]


@query("A01_zone_time_panel", f"select {PANEL_COLUMNS}, {CALENDAR_SQL} from panel15", PANEL_DIGITS)
def _(v):
    return M.zone_time_panel(v.event_trips, 15).select(*PANEL_COLUMNS.split(", "), *CALENDAR)


@query(
    "A01_zone_time_panel_daily",
    f"select {PANEL_COLUMNS} from (" + panel_sql(1440, "trips", "trip_miles", "cast(shared_matched as double)") + ") p",
    PANEL_DIGITS,
)
def _(v):
    return M.zone_time_panel(v.trips, 1440).select(*PANEL_COLUMNS.split(", "))


@query(
    "J08_complete_grid",
    """
with g as (select source, zone_type, zone_id, unnest(generate_series(lo, hi, interval 15 minute)) as time_bin
           from (select distinct source, zone_type, zone_id from panel15) z
           join (select source, zone_type, min(time_bin) as lo, max(time_bin) as hi from panel15 group by 1, 2) s using (source, zone_type))
select g.source, g.zone_type, g.zone_id, g.time_bin, coalesce(p.trip_count, 0) as trip_count,
       case when p.zone_id is null then 0 else p.distinct_dropoff_zones end as distinct_dropoff_zones,
       case when p.zone_id is null then 0 else p.total_fare end as total_fare, p.avg_fare, hour(g.time_bin) as hour
from g left join panel15 p on g.source = p.source and g.zone_type = p.zone_type and g.zone_id = p.zone_id and g.time_bin = p.time_bin
""",
    "total_fare:2 avg_fare:4",
)
def _(v):
    return M.zone_time_panel(v.event_trips, 15, complete=True).select(
        "source",
        "zone_type",
        "zone_id",
        "time_bin",
        "trip_count",
        "distinct_dropoff_zones",
        "total_fare",
        "avg_fare",
        "hour",
    )


cte(
    "od",
    f"""
select source, zone_type, coalesce(pickup_zone_id, {UNKNOWN}) as origin_zone_id, coalesce(dropoff_zone_id, {UNKNOWN}) as destination_zone_id,
       time_bucket(interval 1440 minute, pickup_datetime) as time_bin, count(*) as trip_count, avg(fare) as avg_fare, avg(trip_miles) as avg_trip_miles
from trips group by 1, 2, 3, 4, 5
""",
)
cte(
    "flows",
    "select origin_zone_id, destination_zone_id, cast(sum(trip_count) as bigint) as trip_count from od group by 1, 2",
)
cte(
    "undirected",
    """
select least(origin_zone_id, destination_zone_id) as zone_a, greatest(origin_zone_id, destination_zone_id) as zone_b,
       cast(sum(trip_count) as bigint) as edge_weight,
       cast(sum(case when origin_zone_id < destination_zone_id then trip_count else 0 end) as bigint) as trips_a_to_b,
       cast(sum(case when origin_zone_id > destination_zone_id then trip_count else 0 end) as bigint) as trips_b_to_a
from flows where origin_zone_id <> destination_zone_id group by 1, 2
""",
)
cte(
    "edges",
    """
select zone_a as focal_zone_id, zone_b as neighbor_zone_id, cast(edge_weight as double) as weight from undirected
union all select zone_b, zone_a, cast(edge_weight as double) from undirected
""",
)


def flows_view(v):
    return v.stored("month_flows", lambda: M.od_month(M.od_flow(v.trips, 1440)))


@query("A02_od_flow", "select * from od", "avg_fare:3 avg_trip_miles:4")
def _(v):
    return M.od_flow(v.trips, 1440).drop("service_date", "year", "month")


MOMENTS = """
select count(*) as trip_rows, count(w) as wait_published_rows, count(*) filter (where w >= 0) as wait_valid_rows,
       count(*) filter (where w < 0) as wait_negative_rows, count(*) filter (where w = 0) as wait_zero_rows,
       avg(w) filter (where w >= 0) as wait_mean, stddev_pop(w) filter (where w >= 0) as wait_stddev,
       min(w) filter (where w >= 0) as wait_min, max(w) filter (where w >= 0) as wait_max,
       {q_wait}, {money}, corr(fare, pay) as fare_pay_correlation, sum(pay) / nullif(sum(fare), 0) as pay_to_fare_ratio
from (select fare, tips as pay, case when trip_miles % 9 = 0 then null else cast(datediff('day', pickup_datetime, dropoff_datetime) - 3 as double) end as w from trips) t
"""
MONEY = (
    "count({c}) as {n}_known_rows, count(*) filter (where {c} < 0) as {n}_negative_rows, count(*) filter (where {c} = 0) as {n}_zero_rows, "
    "sum({c}) as {n}_sum, avg({c}) as {n}_mean, stddev_pop({c}) as {n}_stddev, min({c}) as {n}_min, max({c}) as {n}_max, "
    "quantile_cont({c}, 0.1) as {n}_p10, quantile_cont({c}, 0.5) as {n}_p50, quantile_cont({c}, 0.9) as {n}_p90, quantile_cont({c}, 0.99) as {n}_p99"
)
WAITS = (10, 25, 50, 75, 90, 95, 99)
MOMENT_DIGITS = (
    "wait_mean wait_stddev wait_min wait_max fare_sum:1 fare_mean:4 fare_stddev:4 fare_min:2 fare_max:2 pay_sum:1 pay_mean:4 pay_stddev:4 pay_min:4 "
    "pay_max:4 fare_p10:3 fare_p50:3 fare_p90:3 fare_p99:3 pay_p10:3 pay_p50:3 pay_p90:3 pay_p99:3 fare_pay_correlation pay_to_fare_ratio "
    + " ".join(f"wait_p{w}:4" for w in WAITS)
)


def moment_rows(v):
    wait = F.datediff("dropoff_datetime", "pickup_datetime") - 3
    return v.trips.select(
        "fare",
        F.col("tips").alias("pay"),
        F.when(F.col("trip_miles") % 9 != 0, wait.cast("double")).alias("wait"),
    )


@query(
    "A03_trip_moments",
    MOMENTS.format(
        q_wait=", ".join(f"quantile_cont(w, {w / 100}) filter (where w >= 0) as wait_p{w}" for w in WAITS),
        money=MONEY.format(c="fare", n="fare") + ", " + MONEY.format(c="pay", n="pay"),
    ),
    MOMENT_DIGITS,
)
def _(v):
    return M.trip_moments(moment_rows(v), "wait", "fare", "pay")


@query("A03_trip_moments_approximate")
def _(v):
    return M.trip_moments(moment_rows(v), "wait", "fare", "pay", approximate=True)


@query(
    "A04_variance_decomposition",
    """
with c as (select zone_id, time_bin, hour(time_bin) as h, cast(trip_count as double) as y, trip_count from panel60),
g as (select count(*) as n, avg(y) as m, var_pop(y) as v from c),
z as (select zone_id, count(*) as n, avg(y) as m from c group by zone_id), h as (select h, count(*) as n, avg(y) as m from c group by h),
zb as (select sum(z.n * power(z.m - g.m, 2)) / max(g.n) as x from z, g), zw as (select sum(power(c.y - z.m, 2)) / max(g.n) as x from c join z using (zone_id), g),
hb as (select sum(h.n * power(h.m - g.m, 2)) / max(g.n) as x from h, g), hw as (select sum(power(c.y - h.m, 2)) / max(g.n) as x from c join h using (h), g)
select g.n as panel_cells, (select count(*) from z) as zones, (select count(distinct time_bin) from c) as periods, g.m as mean_cell,
       g.v as total_cell_variance, (select count(*) from c where y > 0) as occupied_cells,
       cast((select sum(trip_count) from c) as bigint) as total_completed_trips, zb.x as between_zone_component,
       zw.x as within_zone_temporal_component, zb.x / g.v as icc_like_between_zone_share, zb.x + zw.x - g.v as zone_decomposition_residual,
       hb.x as between_hour_of_day_component, hw.x as within_hour_of_day_component, hb.x / g.v as between_hour_of_day_share,
       hb.x + hw.x - g.v as hour_decomposition_residual
from g, zb, zw, hb, hw
""",
    "mean_cell total_cell_variance between_zone_component within_zone_temporal_component icc_like_between_zone_share "
    "zone_decomposition_residual between_hour_of_day_component within_hour_of_day_component between_hour_of_day_share "
    "hour_decomposition_residual",
)
def _(v):
    return M.variance_decomposition(M.zone_time_panel(v.event_trips, 60))


@query(
    "A05_graph_summary",
    """
with t as (select count(*) as directed_pairs, sum(trip_count) as total_trips, sum(case when origin_zone_id = destination_zone_id then trip_count end) as intra,
                  greatest(count(distinct origin_zone_id), count(distinct destination_zone_id)) as nodes from flows),
e as (select count(*) as n, sum(edge_weight) as c, sum(power(cast(edge_weight as double), 2)) / power(cast(sum(edge_weight) as double), 2) as h from undirected),
r as (select sum(edge_weight) as top from (select edge_weight from undirected order by edge_weight desc, zone_a, zone_b limit 10) x)
select directed_pairs, cast(total_trips as bigint) as total_trips, cast(coalesce(intra, 0) as bigint) as intra_zone_trips, nodes,
       e.n as undirected_cross_zone_edges, cast(e.c as bigint) as cross_zone_trips, e.h as edge_weight_hhi, e.c::double / total_trips as cross_zone_share,
       e.n::double / (nodes * (nodes - 1) / 2) as undirected_density, r.top::double / e.c as top_10_edge_weight_share
from t, e, r
""",
    "edge_weight_hhi:8 cross_zone_share undirected_density top_10_edge_weight_share",
)
def _(v):
    return M.graph_summary(flows_view(v))


@query(
    "A06_node_table",
    """
with n as (select origin_zone_id as zone_id from flows union select destination_zone_id from flows),
o as (select origin_zone_id as zone_id, sum(trip_count) as ob, count(*) filter (where destination_zone_id <> origin_zone_id) as od,
             sum(power(trip_count::double, 2)) / power(sum(trip_count)::double, 2) as hhi, sum(case when destination_zone_id = origin_zone_id then trip_count end) as slf from flows group by 1),
i as (select destination_zone_id as zone_id, sum(trip_count) as ib, count(*) filter (where destination_zone_id <> origin_zone_id) as id from flows group by 1),
s as (select focal_zone_id as zone_id, count(*) as deg, cast(sum(weight) as bigint) as st from edges group by 1)
select n.zone_id, cast(coalesce(ob, 0) as bigint) as outbound_trips, cast(coalesce(ib, 0) as bigint) as inbound_trips, cast(coalesce(slf, 0) as bigint) as self_loop_trips,
       coalesce(od, 0) as cross_zone_out_degree, coalesce(id, 0) as cross_zone_in_degree, coalesce(deg, 0) as undirected_degree,
       coalesce(st, 0) as undirected_strength, coalesce(st, 0)::double / sum(coalesce(st, 0)) over () as undirected_strength_share,
       hhi as outbound_destination_hhi, coalesce(slf, 0)::double / nullif(ob, 0) as outbound_self_loop_share
from n left join o using (zone_id) left join i using (zone_id) left join s using (zone_id)
""",
    "undirected_strength_share outbound_destination_hhi outbound_self_loop_share",
)
def _(v):
    return M.node_table(flows_view(v))


@query(
    "A07_hour_profile",
    """
select hour(time_bin) as hour_of_day, count(*) as zone_hour_cells, count(distinct zone_id) as zones, count(distinct cast(time_bin as date)) as dates,
       cast(sum(trip_count) as bigint) as completed_trips, avg(trip_count) as mean_trips_per_zone_hour, var_pop(trip_count) as cell_variance,
       stddev_pop(trip_count) as cell_stddev, quantile_cont(trip_count, 0.5) as cell_p50, quantile_cont(trip_count, 0.9) as cell_p90
from panel60 group by 1
""",
    "mean_trips_per_zone_hour cell_variance cell_stddev cell_p50 cell_p90",
)
def _(v):
    return M.hour_profile(M.zone_time_panel(v.event_trips, 60))


@query(
    "A07_zone_profile",
    """
select zone_id, count(*) as hourly_cells, count(*) filter (where trip_count > 0) as occupied_cells, cast(sum(trip_count) as bigint) as completed_trips,
       sum(trip_count)::double / sum(sum(trip_count)) over () as month_trip_share, avg(trip_count) as mean_trips_per_hour,
       var_pop(trip_count) as temporal_variance, stddev_pop(trip_count) as temporal_stddev, quantile_cont(trip_count, 0.5) as hourly_p50,
       quantile_cont(trip_count, 0.9) as hourly_p90, max(trip_count) as hourly_max
from panel60 group by zone_id
""",
    "month_trip_share mean_trips_per_hour temporal_variance temporal_stddev hourly_p50 hourly_p90",
)
def _(v):
    return M.zone_profile(M.zone_time_panel(v.event_trips, 60))


@query(
    "A08_daily_summary",
    """
select cast(pickup_datetime as date) as service_date, isodow(cast(pickup_datetime as date)) as iso_weekday, count(*) as trip_count,
       count(*)::double / sum(count(*)) over () as month_share, count(distinct pickup_zone_id) as active_zones, avg(fare) as avg_fare,
       avg(cast(shared_requested as double)) as shared_requested_share
from event_trips group by 1, 2
""",
    "month_share avg_fare:4 shared_requested_share",
)
def _(v):
    return M.daily_summary(v.event_trips)


PER_DATE = (
    "count(*) as trip_count, count(distinct cast(pickup_datetime as date)) as dates_observed, "
    "count(*)::double / count(distinct cast(pickup_datetime as date)) as mean_trips_per_date, avg(fare) as avg_fare, "
    "avg(cast(shared_requested as double)) as shared_requested_share"
)


@query(
    "A08_hourly_summary",
    f"select hour(pickup_datetime) as hour, {PER_DATE}, count(*)::double / sum(count(*)) over () as month_share from event_trips group by 1",
    "month_share mean_trips_per_date avg_fare:4 shared_requested_share",
)
def _(v):
    return M.hourly_summary(v.event_trips)


@query(
    "A08_weekday_summary",
    f"select isodow(pickup_datetime) as iso_weekday, {PER_DATE} from event_trips group by 1",
    "mean_trips_per_date avg_fare:4 shared_requested_share",
)
def _(v):
    return M.weekday_summary(v.event_trips)


@query(
    "A08_zone_summary",
    """
select pickup_zone_id as zone_id, count(*) as trip_count, count(*)::double / sum(count(*)) over () as month_share,
       count(distinct date_trunc('hour', pickup_datetime)) as occupied_hours, avg(fare) as avg_fare, avg(cast(shared_requested as double)) as shared_requested_share
from event_trips group by 1
""",
    "month_share avg_fare:4 shared_requested_share",
)
def _(v):
    return M.zone_summary(v.event_trips)


@query(
    "A08_od_month_summary",
    """
select origin_zone_id, destination_zone_id, cast(sum(trip_count) as bigint) as trip_count, sum(avg_fare * trip_count) / sum(trip_count) as avg_fare,
       sum(avg_trip_miles * trip_count) / sum(trip_count) as avg_trip_miles,
       sum(trip_count)::double / sum(sum(trip_count)) over (partition by origin_zone_id) as origin_flow_share
from od group by 1, 2
""",
    "avg_fare:3 avg_trip_miles:4 origin_flow_share",
)
def _(v):
    return M.od_month_summary(M.od_flow(v.trips, 1440))


@query(
    "A09_demand_by_hour",
    "select hour(time_bin) as hour_of_day, avg(trip_count) as mean_trip_count, cast(sum(trip_count) as bigint) as total_trip_count, count(*) as cells from panel60 group by 1",
    "mean_trip_count",
)
def _(v):
    return M.demand_by_hour(M.zone_time_panel(v.event_trips, 60))


@query(
    "A09_demand_by_zone",
    "select zone_id, avg(trip_count) as mean_trip_count, cast(sum(trip_count) as bigint) as total_trip_count, count(*) as periods_observed from panel60 group by 1",
    "mean_trip_count",
)
def _(v):
    return M.demand_by_zone(M.zone_time_panel(v.event_trips, 60))


@query(
    "A09_cross_zone_correlation",
    """
with c as (select zone_id, time_bin, cast(sum(trip_count) as double) as y from panel60 group by 1, 2)
select a.zone_id as origin_zone, b.zone_id as comparison_zone, corr(a.y, b.y) as demand_correlation
from c a join c b on a.time_bin = b.time_bin group by 1, 2 having count(*) >= 2 and not isnan(corr(a.y, b.y))
""",
    "demand_correlation",
)
def _(v):
    return M.cross_zone_correlation(M.zone_time_panel(v.event_trips, 60))


@query(
    "A10_panel_moments",
    """
with p as (select *, lag(trip_count) over (partition by zone_id order by time_bin) as prev, cast(zone_id as double) as income,
                  cast(day(time_bin) % 3 = 0 as double) as weather, cast(day(time_bin) % 7 as double) as event from panel60),
x as (select corr(a.trip_count, b.trip_count) as r, count(*) as n from p a join p b on a.zone_id = b.zone_id and a.time_bin = b.time_bin + interval 1 hour),
m as (select quantile_cont(income, 0.5) as cut from p)
select count(*) as panel_rows, count(distinct zone_id) as zones, count(distinct time_bin) as periods, cast(sum(trip_count) as double) as total_observed_trips,
       avg(trip_count) as mean_trips_per_cell, quantile_cont(trip_count, 0.9) as p90_trips_per_cell,
       sum(avg_fare * trip_count) / sum(case when avg_fare is not null then trip_count end) as mean_observed_fare, avg(avg_fare) as equal_observed_cell_mean_fare,
       corr(avg_fare, trip_count) as fare_demand_correlation,
       sum(shared_requested_share * trip_count) / sum(case when shared_requested_share is not null then trip_count end) as mean_pooled_trip_share,
       corr(trip_count, prev) as previous_cell_correlation, max(x.r) as exact_lag_correlation, max(x.n) as exact_lag_support_pairs,
       avg(case when income >= cut then trip_count end) - avg(case when income < cut then trip_count end) as income_mean_contrast, count(income) as income_known_rows,
       avg(case when weather > 0 then trip_count end) - avg(case when weather <= 0 then trip_count end) as weather_mean_contrast, count(weather) as weather_known_rows,
       avg(case when event > 0 then trip_count end) - avg(case when event <= 0 then trip_count end) as event_mean_contrast, count(event) as event_known_rows
from p, x, m
""",
    "total_observed_trips:1 mean_trips_per_cell p90_trips_per_cell mean_observed_fare:4 equal_observed_cell_mean_fare:4 fare_demand_correlation "
    "mean_pooled_trip_share previous_cell_correlation exact_lag_correlation income_mean_contrast weather_mean_contrast event_mean_contrast",
)
def _(v):
    day = F.day("time_bin")
    panel = M.zone_time_panel(v.event_trips, 60).withColumns(
        {
            "income": F.col("zone_id").try_cast("double"),
            "weather": (day % 3 == 0).cast("double"),
            "event": (day % 7).cast("double"),
        }
    )
    return M.panel_moments(
        panel, 60, {"income": "income", "weather": "weather", "event": "event"}
    )


@query(
    "A11_od_summary",
    """
select pickup_zone_id as origin_zone, dropoff_zone_id as destination_zone, count(*) as trip_count,
       count(*)::double / sum(count(*)) over (partition by pickup_zone_id) as origin_flow_share
from trips group by 1, 2
""",
    "origin_flow_share",
)
def _(v):
    return M.od_summary(v.trips)


@query("U01_symmetric_edges", "select * from edges", "weight:1")
def _(v):
    return M.symmetric_edges(M.od_edges(flows_view(v)))


@query("U02_graph_nodes", "select origin_zone_id as zone_id from flows union select destination_zone_id from flows")
def _(v):
    return M.graph_nodes(flows_view(v))


@query(
    "W08_group_shares",
    """
select source_zone as pickup_zone_id, arg_min(total, day) as first_value, arg_max(total, day) as last_value, sum(total) as total_value,
       sum(total) / sum(sum(total)) over () as share_of_total
from (select pickup_zone_id as source_zone, cast(pickup_datetime as date) as day, sum(fare) as total from trips group by 1, 2) d group by 1
""",
    "first_value:2 last_value:2 total_value:1 share_of_total",
)
def _(v):
    daily = v.trips.groupBy("pickup_zone_id", F.to_date("pickup_datetime").alias("day")).agg(
        F.sum("fare").alias("total")
    )
    return M.group_shares(daily, "pickup_zone_id", "day", "total")


@query(
    "J10_exact_lag",
    """
select a.zone_id, a.time_bin, a.trip_count, b.trip_count as prior_trip_count from panel60 a
join panel60 b on a.zone_id = b.zone_id and a.time_bin = b.time_bin + interval 2 hour
""",
)
def _(v):
    panel = M.zone_time_panel(v.event_trips, 60).select("zone_id", "time_bin", "trip_count")
    return M.exact_lag(
        panel, ["zone_id"], "time_bin", "interval 2 hours", {"trip_count": "prior_trip_count"}
    )


@query(
    "J10_autocorrelation",
    " union all ".join(
        f"""
select cast({k} as integer) as lag_hours, count(*) as exact_lag_support_pairs,
       (select cast(sum(greatest(datediff('hour', lo, hi) + 1 - {k}, 0)) as bigint) from (select min(time_bin) as lo, max(time_bin) as hi from panel60 group by zone_id) s) as possible_pairs_on_hourly_span,
       count(*)::double / (select sum(greatest(datediff('hour', lo, hi) + 1 - {k}, 0)) from (select min(time_bin) as lo, max(time_bin) as hi from panel60 group by zone_id) s) as support_share,
       corr(a.trip_count, b.trip_count) as pooled_trip_count_correlation, corr(a.trip_count - m, b.trip_count - m) as within_zone_centered_correlation,
       avg(a.trip_count) as current_mean, avg(b.trip_count) as lagged_mean
from panel60 a join panel60 b on a.zone_id = b.zone_id and a.time_bin = b.time_bin + interval {k} hour
join (select zone_id, avg(trip_count) as m from panel60 group by zone_id) z on a.zone_id = z.zone_id"""
        for k in (1, 24, 168)
    ),
    "support_share pooled_trip_count_correlation within_zone_centered_correlation current_mean lagged_mean",
)
def _(v):
    return M.autocorrelation(M.zone_time_panel(v.event_trips, 60), (1, 24, 168))


@query(
    "J11_neighbor_exposure",
    """
with w as (select *, weight / sum(weight) over (partition by focal_zone_id) as nw, count(*) over (partition by focal_zone_id) as k from edges
           where neighbor_zone_id <> '__MISSING_OR_OUTSIDE__' and focal_zone_id <> '__MISSING_OR_OUTSIDE__'),
a as (select cast(zone_id as varchar) as zone_id, period_id, assigned_treatment as treatment from assignments where not (zone_id = 3 and period_id = 5)),
x as (select focal_zone_id as zone_id, period_id, sum(nw * treatment) as e, count(*) as n, max(k) as k from w join a on w.neighbor_zone_id = a.zone_id group by 1, 2)
select a.zone_id, cast(a.period_id as integer) as period_id, a.treatment, case when x.n = x.k then x.e end as neighbor_exposure, p.treatment as own_history_lag_1
from a left join x on a.zone_id = x.zone_id and a.period_id = x.period_id
left join a p on a.zone_id = p.zone_id and a.period_id = p.period_id + 1
""",
    "neighbor_exposure",
)
def _(v):
    out = M.neighbor_exposure(assign_view(v), edges_view(v), history_lags=1)
    return out.select("zone_id", "period_id", "treatment", "neighbor_exposure", "own_history_lag_1")


def assign_view(v):
    return (
        v.assignments.where(~((F.col("zone_id") == 3) & (F.col("period_id") == 5)))
        .withColumn("zone_id", F.col("zone_id").cast("string"))
        .withColumnRenamed("assigned_treatment", "treatment")
    )


def edges_view(v):
    edges = M.symmetric_edges(M.od_edges(flows_view(v)))
    return edges.where(
        (F.col("focal_zone_id") != M.UNKNOWN_ZONE) & (F.col("neighbor_zone_id") != M.UNKNOWN_ZONE)
    )


# --- areas ------------------------------------------------------------------------

cte(
    "tract_bins",
    """
select c_nationkey as tract, b.bin, b.lower, b.upper, count(c_custkey) as households, 2.0::double + sqrt(count(c_custkey)) as moe
from (select c_custkey, c_nationkey, cast(least(greatest(floor((c_acctbal + 1000) / 1000), 0), 9) as integer) as bin from customer) c
join (select cast(i as integer) as bin, (i - 1) * 1000.0::double as lower, case when i < 9 then i * 1000.0::double end as upper from range(0, 10) t(i)) b on c.bin = b.bin
group by 1, 2, 3, 4
""",
)


def tract_bins(v):
    bin_ = F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 1000), F.lit(0)), F.lit(9))
    b = F.col("bin")
    return (
        v.customer.groupBy(F.col("c_nationkey").alias("tract"), bin_.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("households"))
        .withColumns(
            {
                "lower": (b - 1) * 1000.0,
                "upper": F.when(b < 9, b * 1000.0),
                "moe": 2.0 + F.sqrt("households"),
            }
        )
    )


cte(
    "area_bins",
    """
select n_regionkey as area, bin, lower, upper, cast(sum(households) as bigint) as households, sqrt(sum(moe * moe)) as moe
from tract_bins join nation on tract = n_nationkey group by 1, 2, 3, 4
""",
)
GROUPED = """
select {k}, case when upper is null then lower else lower + least(greatest((0.5::double * t - (cum - households)) / households, 0), 1) * (upper - lower) end as grouped_median,
       upper is null as top_coded
from (select *, row_number() over (partition by {k} order by bin) as rn from (
        select *, sum(households) over (partition by {k} order by bin) as cum, sum(households) over (partition by {k}) as t from {src}) c where cum >= 0.5::double * t) m where rn = 1
"""


@query(
    "A32_binned_income",
    f"""
with g as ({GROUPED.format(k="area", src="area_bins")})
select b.area, cast(sum(households) as bigint) as households, sqrt(sum(moe * moe)) as moe, sum(case when upper <= 2000 then households else 0 end) / sum(households)::double as share_low,
       sum(case when lower >= 5000 then households else 0 end) / sum(households)::double as share_high, max(g.grouped_median) as grouped_median, bool_or(g.top_coded) as top_coded
from area_bins b join g on b.area = g.area group by b.area
""",
    "moe share_low share_high grouped_median:4",
)
def _(v):
    mapping = v.nation.select(F.col("n_nationkey").alias("tract"), F.col("n_regionkey").alias("area"))
    return AR.binned_income(tract_bins(v), mapping, 2000.0, 5000.0)


cte(
    "zone_bins",
    """
select w.zone, a.bin, a.lower, a.upper, sum(w.weight * a.households) as households
from (select s_nationkey as zone, n_regionkey as area, count(*) / sum(count(*)) over (partition by n_regionkey)::double as weight
      from supplier join nation on s_nationkey = n_nationkey group by 1, 2) w
join area_bins a on w.area = a.area group by 1, 2, 3, 4
""",
)
cte(
    "zone_groups",
    f"""
with g as ({GROUPED.format(k="zone", src="zone_bins")}),
c as (select grouped_median as m from ({GROUPED.format(k="one", src="(select 1 as one, bin, lower, upper, sum(households) as households from area_bins group by 1, 2, 3, 4) u")}) x)
select z.zone, sum(z.households) as households, max(g.grouped_median) as grouped_median, bool_or(g.top_coded) as top_coded,
       case when sum(z.households) < 30 then 'unclassified' when max(g.grouped_median) < max(c.m) then 'low_income_area' else 'high_income_area' end as income_group
from zone_bins z join g on z.zone = g.zone, c group by z.zone
""",
)


def zone_groups(v):
    nations = v.nation.select(F.col("n_nationkey"), F.col("n_regionkey").alias("area"))
    counts = (
        v.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("s_nationkey").alias("zone"), "area")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    crosswalk = M.with_share(counts, ["area"], "n", "weight")
    bins = (
        tract_bins(v)
        .join(nations, F.col("tract") == F.col("n_nationkey"))
        .groupBy("area", "bin", "lower", "upper")
        .agg(F.sum("households").alias("households"))
    )
    city = bins.groupBy(F.lit(1).alias("one"), "bin", "lower", "upper").agg(
        F.sum("households").alias("households")
    )
    median = AR.grouped_median(city, ["one"]).select("grouped_median").scalar()
    return AR.allocate(crosswalk, bins, median, 30.0)


@query(
    "A33_allocate",
    "select *, 0.0::double as weight_sum_error from zone_groups",
    "households:4 grouped_median:3 weight_sum_error",
)
def _(v):
    return zone_groups(v)


cte("group_map", "select cast(zone as varchar) as zone_id, income_group from zone_groups where zone <> 7")
cte(
    "daily_zone",
    """
select zone_id, cast(time_bin as date) as service_date, count(*) as zone_hours, count(*) filter (where trip_count > 0) as occupied_zone_hours,
       cast(sum(trip_count) as bigint) as published_completed_trips, coalesce(max(income_group), 'unclassified') as income_group
from panel60 left join group_map using (zone_id) group by 1, 2
""",
)


def group_map(v):
    return zone_groups(v).where("zone <> 7").select(
        F.col("zone").cast("string").alias("zone_id"), "income_group"
    )


ACTIVITY = (
    "count(distinct zone_id) as panel_zones, cast(sum(zone_hours) as bigint) as zone_hours, cast(sum(occupied_zone_hours) as bigint) as occupied_zone_hours, "
    "cast(sum(published_completed_trips) as bigint) as published_completed_trips, sum(published_completed_trips)::double / sum(zone_hours) as mean_trips_per_zone_hour"
)


@query(
    "A34_group_daily",
    f"select service_date, income_group, {ACTIVITY} from daily_zone group by 1, 2",
    "mean_trips_per_zone_hour",
)
def _(v):
    return AR.group_daily(M.zone_time_panel(v.event_trips, 60), group_map(v))


@query(
    "A34_group_monthly",
    f"""
with m as (select income_group, {ACTIVITY}, count(distinct service_date) as observed_days from daily_zone group by 1)
select *, published_completed_trips::double / observed_days as mean_daily_trips, published_completed_trips::double / sum(published_completed_trips) over () as share_of_all_trips,
       case when income_group <> 'unclassified' then published_completed_trips::double / (select sum(published_completed_trips) from m where income_group <> 'unclassified') end as share_of_classified_trips
from m
""",
    "mean_trips_per_zone_hour mean_daily_trips share_of_all_trips share_of_classified_trips",
)
def _(v):
    return AR.group_monthly(M.zone_time_panel(v.event_trips, 60), group_map(v))


@query(
    "A34_group_zones",
    """
with s as (select zone_id, count(*) as panel_days, cast(sum(zone_hours) as bigint) as zone_hours, cast(sum(published_completed_trips) as bigint) as published_completed_trips
           from daily_zone group by 1)
select coalesce(g.zone_id, s.zone_id) as zone_id, coalesce(income_group, 'unclassified') as income_group, g.zone_id is not null as official_zone,
       s.zone_id is not null as observed_in_panel, panel_days, zone_hours, published_completed_trips
from group_map g full join s on g.zone_id = s.zone_id
""",
)
def _(v):
    return AR.group_zones(M.zone_time_panel(v.event_trips, 60), group_map(v))


# --- interval days and daily signals ----------------------------------------------

cte(
    "intervals",
    """
select o_orderkey as event_id, o_orderpriority as event_name, o_orderdate as start_at,
       o_orderdate + cast((o_orderkey % 9 - 1) * 24 + o_orderkey % 5 * 6 as integer) * interval 1 hour as end_at,
       o_orderstatus = 'F' as public, o_totalprice > 400000 as major
from orders
""",
)
FIRST, LAST = "1995-06-01", "2001-06-30"
cte(
    "interval_days",
    f"""
select event_id, event_name, public, major, cast(unnest(generate_series(greatest(cast(start_at as date), date '{FIRST}'),
       least(cast(end_at - interval 1 microsecond as date), date '{LAST}'), interval 1 day)) as date) as service_date
from intervals where end_at > start_at
""",
)


def intervals(v):
    k = F.col("o_orderkey")
    hours = ((k % 9 - 1) * 24 + k % 5 * 6).cast("int")
    return v.orders.select(
        k.alias("event_id"),
        F.col("o_orderpriority").alias("event_name"),
        F.col("o_orderdate").alias("start_at"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=hours)).alias("end_at"),
        (F.col("o_orderstatus") == "F").alias("public"),
        (F.col("o_totalprice") > 400000).alias("major"),
    )


@query("J15_expand_days", "select event_id, service_date, event_name, major from interval_days")
def _(v):
    days = AR.expand_days(intervals(v), "event_id", "start_at", "end_at", FIRST, LAST)
    return days.select("event_id", "service_date", "event_name", "major")


@query(
    "J15_flag_intervals",
    "select usable, count(*) as n from (select end_at > start_at as usable from intervals) i group by 1",
)
def _(v):
    flagged = AR.flag_intervals(intervals(v), "start_at", "end_at")
    return flagged.groupBy("usable").agg(F.count(F.lit(1)).alias("n"))


@query("A36_major_names", "select distinct service_date, event_name from interval_days where major")
def _(v):
    return AR.major_names(AR.expand_days(intervals(v), "event_id", "start_at", "end_at", FIRST, LAST))


@query(
    "A36_event_calendar",
    f"""
with c as (select cast(unnest(generate_series(date '{FIRST}', date '{LAST}', interval 1 day)) as date) as service_date),
d as (select service_date, count(distinct event_id) as a, count(*) filter (where public) as p, count(*) filter (where major) as m,
             count(distinct case when major then event_name end) as nm, min(case when major then event_name end) as f,
             string_agg(distinct case when major then event_name end, ' | ' order by case when major then event_name end) as names from interval_days group by 1),
t as (select c.service_date, coalesce(a, 0) as active_events, coalesce(p, 0) as active_public_events, coalesce(m, 0) as active_major_events, coalesce(nm, 0) as n_major_names, f as first_major_name,
             coalesce(names, '') as major_names
      from c left join d on c.service_date = d.service_date),
q as (select quantile_cont(active_events, 0.5) as med from t)
select t.*, active_major_events > 0 as is_major_day, q.med as median_active_events, active_events > q.med as above_median_day from t, q
""",
    "median_active_events",
)
def _(v):
    days = AR.expand_days(intervals(v), "event_id", "start_at", "end_at", FIRST, LAST)
    return AR.event_calendar(days, FIRST, LAST)


cte(
    "order_panel",
    """
select o_orderpriority as zone_id, date_trunc('day', o_orderdate) + cast(o_orderkey % 24 as integer) * interval 1 hour as time_bin, count(*) as trip_count
from orders group by 1, 2
""",
)


def order_panel(v):
    hour = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return v.orders.groupBy(
        F.col("o_orderpriority").alias("zone_id"),
        (F.date_trunc("day", "o_orderdate").cast("timestamp_ntz") + hour).alias("time_bin"),
    ).agg(F.count(F.lit(1)).alias("trip_count"))


@query(
    "A35_signal_associations",
    """
with d as (select cast(time_bin as date) as service_date, sum(trip_count) as trips from order_panel group by 1),
j as (select d.trips, s.temperature_max_c as sig, s.temperature_min_c <= 0 as f, isodow(d.service_date) as wd from d join daily_signal s on d.service_date = s.service_date),
c as (select *, trips - avg(trips) over (partition by wd) as ct, sig - avg(sig) over (partition by wd) as cs from j)
select count(*) as days, count(*) filter (where f) as exposed_days, count(*) filter (where not f) as comparison_days, avg(trips) filter (where f) as mean_exposed,
       avg(trips) filter (where not f) as mean_comparison, avg(trips) filter (where f) - avg(trips) filter (where not f) as difference,
       (avg(trips) filter (where f) - avg(trips) filter (where not f)) / avg(trips) filter (where not f) as relative_difference,
       corr(trips, sig) as correlation, corr(ct, cs) as within_weekday_correlation
from c
""",
    "mean_exposed mean_comparison difference relative_difference correlation within_weekday_correlation",
)
def _(v):
    calendar = daily_signal(v).withColumn("freezing", F.col("temperature_min_c") <= 0)
    return AR.signal_associations(order_panel(v), calendar, "freezing", "temperature_max_c")


@query(
    "A35_hourly_contrast",
    """
with h as (select cast(time_bin as date) as service_date, hour(time_bin) as hour, sum(trip_count) as trips from order_panel group by 1, 2),
j as (select h.*, s.temperature_min_c <= 0 as f from h join daily_signal s on h.service_date = s.service_date)
select hour, count(*) filter (where f) as days_on, count(*) filter (where not f) as days_off, avg(trips) filter (where f) as mean_on,
       avg(trips) filter (where not f) as mean_off, avg(trips) filter (where f) - avg(trips) filter (where not f) as on_minus_off
from j group by hour
""",
    "mean_on mean_off on_minus_off",
)
def _(v):
    calendar = daily_signal(v).withColumn("freezing", F.col("temperature_min_c") <= 0)
    return AR.hourly_contrast(order_panel(v), calendar, "freezing")


