"""Queries for assignment, estimators, Monte Carlo summaries and event-study designs."""

from pyspark.sql import functions as F

from quaymetrics.core import hash32
from quaymetrics.functions.columns import safe_log
from quaymetrics.operators import estimators as E
from quaymetrics.operators import experiments as X
from quaymetrics.operators import mobility as MB
from quaymetrics.operators import windows as W
from quaymetrics.plans.mobility import assign_view, edges_view
from quaymetrics.plans.policy import panel_view
from quaymetrics.plans.trade import io_view, ppi_view
from quaymetrics.registry import cte, query

H = "('0x' || substr(md5({0}), 1, 8))::bigint"
HALF = 2**31

# --- assignment -------------------------------------------------------------------


@query(
    "E01_assign_individual",
    f"""
with n as (select count(*) as n, least(greatest(round_even(count(*) * 0.3::double, 0), 1), count(*) - 1) as k from customer),
r as (select c_custkey, row_number() over (order by {H.format("cast(c_custkey as varchar) || 's1'")}, c_custkey) as rk from customer)
select c_custkey, cast(rk <= k as integer) as assigned_treatment, k / n as treatment_probability from r, n
""",
    "treatment_probability",
)
def _(v):
    return X.assign_individual(v.customer.select("c_custkey"), "c_custkey", 0.3, "s1")


@query(
    "E01_assign_shares",
    f"""
with c as (select cast(o_custkey as bigint) as unit_id, count(*) as unit_count from orders group by 1),
d as (select unit_id, unit_count, {H.format("cast(unit_id as varchar) || '|' || cast(u as varchar) || 's2'")} < {int(0.4 * 2**32)} as t from (select *, unnest(generate_series(1, unit_count)) as u from c) x)
select unit_id, unit_count, count(*) filter (where t) as treated_units, count(*) filter (where t) / unit_count::double as assigned_treatment from d group by 1, 2
""",
    "assigned_treatment",
)
def _(v):
    cells = v.orders.groupBy(F.col("o_custkey").alias("unit_id")).agg(
        F.count(F.lit(1)).alias("unit_count")
    )
    return X.assign_individual_shares(cells, "unit_id", "unit_count", 0.4, "s2")


def grid(v):
    return v.assignments.select("zone_id", "period_id")


cte("grid", "select zone_id, period_id from assignments")
cte(
    "clustered",
    """
select g.*, c.cluster_id, b.time_block from grid g join (select zone_id, cast((row_number() over (order by zone_id) - 1) // 4 as integer) as cluster_id from (select distinct zone_id from grid) z) c using (zone_id)
join (select period_id, cast((dense_rank() over (order by period_id) - 1) // 3 as integer) as time_block from (select distinct period_id from grid) p) b using (period_id)
""",
)


def arms_sql(keys: str, text: str, p: float) -> str:
    return f"""
select {keys}, cast(row_number() over (order by {H.format(text)}, {keys}) <= least(greatest(round_even(count(*) over () * {p}::double, 0), 1), count(*) over () - 1) as integer) as assigned_treatment,
       least(greatest(round_even(count(*) over () * {p}::double, 0), 1), count(*) over () - 1) / (count(*) over ())::double as treatment_probability from (select distinct {keys} from clustered) d
"""


@query(
    "E02_assign_geo",
    f"select c.zone_id, c.period_id, c.cluster_id, assigned_treatment, treatment_probability from clustered c join ({arms_sql('cluster_id', 'cast(cluster_id as varchar) || ' + repr('geo'), 0.5)}) a using (cluster_id)",
    "treatment_probability",
)
def _(v):
    return X.assign_geo(grid(v), 4, 0.5)


@query(
    "E03_assign_time",
    f"select c.zone_id, c.period_id, c.time_block, assigned_treatment, treatment_probability from clustered c join ({arms_sql('time_block', 'cast(time_block as varchar) || ' + repr('time'), 0.5)}) a using (time_block)",
    "treatment_probability",
)
def _(v):
    return X.assign_time(grid(v), 3, 0.5)


@query(
    "E03_assign_switchback",
    f"""
select zone_id, period_id, time_block, time_block // 2 as switchback_pair, (cast({H.format("cast(time_block // 2 as varchar) || 'switch'")} < {HALF} as integer) + time_block % 2) % 2 as assigned_treatment,
       0.5::double as treatment_probability from clustered
""",
    "treatment_probability",
)
def _(v):
    return X.assign_switchback(grid(v), 3, 0.5)


@query(
    "E04_assign_geo_time",
    f"select c.zone_id, c.period_id, c.cluster_id, c.time_block, assigned_treatment, treatment_probability from clustered c join ({arms_sql('cluster_id, time_block', 'cast(cluster_id as varchar) || ' + repr('|') + ' || cast(time_block as varchar) || ' + repr('cell'), 0.5)}) a using (cluster_id, time_block)",
    "treatment_probability",
)
def _(v):
    return X.assign_geo_time(grid(v), 4, 3, 0.5)


@query(
    "E04_assign_saturation",
    f"""
with z as (select zone_id, cast(floor((row_number() over (order by zone_id) - 1) * 8 / (count(*) over ())::double) as integer) as cluster_id from (select distinct zone_id from grid) q),
k as (select cluster_id, row_number() over (order by {H.format("cast(cluster_id as varchar) || 'sat'")}, cluster_id) as r from (select distinct cluster_id from z) q),
a as (select cluster_id, case when r <= 3 then 0.2::double when r <= 6 then 0.5::double else 0.8::double end as s, case when r <= 6 then 3 / 8.0::double else 2 / 8.0::double end as p from k),
u as (select g.zone_id, g.period_id, z.cluster_id, s, p, unnest(generate_series(1, 20)) as i from grid g join z using (zone_id) join a using (cluster_id))
select zone_id, period_id, cluster_id, s as cluster_saturation, p as saturation_assignment_probability,
       count(*) filter (where {H.format("cast(zone_id as varchar) || '|' || cast(period_id as varchar) || '|' || cast(i as varchar) || 'sat'")} < s * 4294967296.0::double) as treated_units,
       count(*) filter (where {H.format("cast(zone_id as varchar) || '|' || cast(period_id as varchar) || '|' || cast(i as varchar) || 'sat'")} < s * 4294967296.0::double) / 20.0::double as assigned_treatment
from u group by 1, 2, 3, 4, 5
""",
    "cluster_saturation saturation_assignment_probability assigned_treatment",
)
def _(v):
    return X.assign_saturation(grid(v), 8, (0.2, 0.5, 0.8), 20)


@query(
    "E05_enforce_budget",
    """
with g as (select sum(assigned_treatment * (1 + zone_id % 4)) as gross from assignments)
select zone_id, period_id, cast(assigned_treatment as double) as planned_treatment, 100 / gross::double as budget_scale, assigned_treatment * 100 / gross::double as treatment_intensity,
       assigned_treatment * 100 / gross::double * (1 + zone_id % 4) as expected_treatment_cost from assignments, g
""",
    "planned_treatment budget_scale treatment_intensity expected_treatment_cost",
)
def _(v):
    df = v.assignments.withColumn("cost", (1 + F.col("zone_id") % 4).cast("double"))
    out = X.enforce_budget(df, "assigned_treatment", "cost", 100.0)
    return out.drop("cluster_id", "assigned_treatment", "cost")


@query(
    "W10_mark_washout",
    """
with s as (select distinct cluster_id, period_id, assigned_treatment from assignments),
c as (select *, lag(assigned_treatment) over (partition by cluster_id order by period_id, assigned_treatment) as b from s),
w as (select distinct cluster_id, period_id + k as period_id from c, range(0, 2) t(k) where b is not null and b <> assigned_treatment)
select a.zone_id, a.period_id, a.cluster_id, a.assigned_treatment, cast(w.cluster_id is not null as integer) as washout, cast(w.cluster_id is null as integer) as analysis_eligible
from assignments a left join w on a.cluster_id = w.cluster_id and a.period_id = w.period_id
""",
)
def _(v):
    return W.mark_washout(v.assignments, 2)


@query(
    "W10_mark_washout_market",
    """
with s as (select distinct period_id, period_id // 3 % 2 as t from assignments), c as (select *, lag(t) over (order by period_id) as b from s),
w as (select distinct period_id + k as period_id from c, range(0, 2) r(k) where b is not null and b <> t)
select a.zone_id, a.period_id, cast(w.period_id is not null as integer) as washout from assignments a left join w on a.period_id = w.period_id
""",
)
def _(v):
    df = v.assignments.withColumn("assigned_treatment", F.floor(F.col("period_id") / 3) % 2)
    return W.mark_washout(df, 2, cluster=None).select("zone_id", "period_id", "washout")


# --- estimators -------------------------------------------------------------------

cte(
    "units",
    """
select o_orderkey as id, o_totalprice / 1000 + 5 * (o_orderkey % 2) + c_acctbal / 2000 as y, cast(o_orderkey % 2 as integer) as t, c_acctbal / 1000 + (o_orderkey % 7) as x,
       c_nationkey as g, month(o_orderdate) as h from orders join customer on o_custkey = c_custkey
""",
)


def units(v):
    k = F.col("o_orderkey")
    return v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("id"),
        (F.col("o_totalprice") / 1000 + 5 * (k % 2) + F.col("c_acctbal") / 2000).alias("y"),
        (k % 2).cast("int").alias("t"),
        (F.col("c_acctbal") / 1000 + k % 7).alias("x"),
        F.col("c_nationkey").alias("g"),
        F.month("o_orderdate").alias("h"),
    )


@query(
    "E06_diff_in_means",
    """
with a as (select avg(y) filter (where t = 1) as m1, avg(y) filter (where t = 0) as m0, var_samp(y) filter (where t = 1) / count(*) filter (where t = 1) as v1,
  var_samp(y) filter (where t = 0) / count(*) filter (where t = 0) as v0, count(*) filter (where t = 1) as n1, count(*) filter (where t = 0) as n0 from units)
select m1 - m0 as estimate, sqrt(v1 + v0) as standard_error, power(v1 + v0, 2) / (v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)) as degrees_freedom, (m1 - m0) / sqrt(v1 + v0) as t_stat,
       n1 as n_treated, n0 as n_control from a
""",
    "estimate standard_error degrees_freedom:2 t_stat",
)
def _(v):
    return E.diff_in_means(units(v), "y", "t")


SLOPE = """
with b as (select regr_slope(y, x) as b1, regr_intercept(y, x) as b0, avg(x) as xm, count(*) as n, regr_sxx(y, x) as sxx from units),
e as (select y - b0 - b1 * x as e, x - xm as d, g, h from units, b)
"""


def slope_row(fit):
    return fit.where(F.col("term") == "x").select("estimate", "std_error", "n_obs", "n_clusters")


@query(
    "E07_ols_hc1",
    SLOPE
    + "select max(b1) as estimate, sqrt(max(n) / (max(n) - 2)::double * sum(d * d * e * e)) / max(sxx) as std_error, max(n) as n_obs, max(n) as n_clusters from e, b",
    "estimate std_error",
)
def _(v):
    return slope_row(E.ols(units(v), "y", ["x"]))


ONE_WAY = "(select sum(s * s) * count(*) / (count(*) - 1)::double from (select sum(d * e) as s from e group by {k}) q)"


@query(
    "E08_ols_cluster",
    SLOPE
    + f"select b1 as estimate, sqrt((n - 1) / (n - 2)::double * {ONE_WAY.format(k='g')}) / sxx as std_error, n as n_obs, (select count(distinct g) from e) as n_clusters from b",
    "estimate std_error",
)
def _(v):
    return slope_row(E.ols(units(v), "y", ["x"], ["g"]))


@query(
    "E08_ols_two_way",
    SLOPE
    + f"select b1 as estimate, sqrt((n - 1) / (n - 2)::double * ({ONE_WAY.format(k='g')} + {ONE_WAY.format(k='h')} - {ONE_WAY.format(k='g, h')})) / sxx as std_error, n as n_obs, "
    "least((select count(distinct g) from e), (select count(distinct h) from e)) as n_clusters from b",
    "estimate std_error",
)
def _(v):
    return slope_row(E.ols(units(v), "y", ["x"], ["g", "h"]))


cte(
    "did_panel",
    """
select cast(o_custkey % 20 as integer) as unit, cast(date_trunc('quarter', o_orderdate) as date) as time, avg(o_totalprice) / 1000 + case when o_custkey % 20 < 6 and date_trunc('quarter', o_orderdate) >= date '1998-07-01' then 25 else 0 end as y,
       cast(o_custkey % 20 < 6 as integer) as treated, cast(date_trunc('quarter', o_orderdate) >= date '1998-07-01' as integer) as post
from orders group by o_custkey % 20, date_trunc('quarter', o_orderdate)
""",
)


def did_panel(v):
    quarter = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    cells = v.orders.groupBy(
        (F.col("o_custkey") % 20).cast("int").alias("unit"), quarter.alias("time")
    ).agg((F.avg("o_totalprice") / 1000).alias("m"))
    treated, post = F.col("unit") < 6, F.col("time") >= F.lit("1998-07-01").cast("date")
    return cells.select(
        "unit",
        "time",
        (F.col("m") + F.when(treated & post, 25).otherwise(0)).alias("y"),
        treated.cast("int").alias("treated"),
        post.cast("int").alias("post"),
    )


DID = "avg(y) filter (where treated = 1 and post = 1) - avg(y) filter (where treated = 1 and post = 0) - avg(y) filter (where treated = 0 and post = 1) + avg(y) filter (where treated = 0 and post = 0)"


@query("E09_did", f"select {DID} as estimate, count(*) as n_obs from did_panel", "estimate:5")
def _(v):
    fit = E.did(did_panel(v), "y", "unit", "time", "treated", "post")
    return fit.select("estimate", "n_obs")


@query(
    "E09_did_balanced",
    f"select {DID} as estimate, count(distinct unit) as n_units, count(distinct time) as n_periods from did_panel",
    "estimate:5",
)
def _(v):
    return E.did_balanced(did_panel(v), "y", "unit", "time", "treated", "post")


@query(
    "E10_ols_one_effect",
    """
with d as (select y - avg(y) over (partition by h) as y, x - avg(x) over (partition by h) as x, g, h from units), b as (select sum(x * y) / sum(x * x) as b, sum(x * x) as sxx, count(*) as n, count(distinct h) as k from d),
s as (select g, sum(x * (y - b * x)) as s from d, b group by g)
select b as estimate, (select sqrt(sum(s * s) * count(*) / (count(*) - 1)::double) from s) * sqrt((n - 1) / (n - 1 - k)::double) / sxx as std_error, n as n_obs, (select count(*) from s) as n_clusters from b
""",
    "estimate std_error",
)
def _(v):
    return slope_row(E.ols_hdfe(units(v), "y", ["x"], ["h"], ["g"]))


def regression_panel(v):
    return panel_view(v).withColumns(
        {
            "log_tariff": safe_log(1 + F.coalesce("additional_tariff_rate", F.lit(0.0))),
            "value_k": F.col("customs_value") / 1000,
        }
    )


@query("E10_ols_two_effects")
def _(v):
    return E.ols_hdfe(
        regression_panel(v), "log_customs_value", ["log_tariff"], ["flow_id", "month_key"], ["hs10"]
    )


# Double-demeaned by unit and period, which is exact on the balanced panel.
cte(
    "crossed",
    "select *, treated * post + (unit * (year(time) * 4 + quarter(time)) % 5) as x, unit % 7 as e1, unit % 3 as e2 from did_panel",
)


def demeaned(c: str, name: str) -> str:
    return f"{c} - avg({c}) over (partition by unit) - avg({c}) over (partition by time) + avg({c}) over () as {name}"


def crossed(v):
    quarter = F.year("time") * 4 + F.quarter("time")
    return did_panel(v).withColumns(
        {
            "x": (F.col("treated") * F.col("post") + F.col("unit") * quarter % 5).cast("double"),
            "e1": F.col("unit") % 7,
            "e2": F.col("unit") % 3,
            "cluster": F.col("unit"),
        }
    )


LEVELS = "(select count(distinct unit) + count(distinct time) - 1 from did_panel)"


@query(
    "E10_ols_two_effects_balanced",
    f"""
with d as (select unit, {demeaned('y', 'y')}, {demeaned('x', 'x')} from crossed), b as (select sum(x * y) / sum(x * x) as b, sum(x * x) as sxx, count(*) as n from d),
s as (select unit, sum(x * (y - b * x)) as s from d, b group by unit)
select b as estimate, (select sqrt(sum(s * s) * count(*) / (count(*) - 1)::double) from s) * sqrt((n - 1) / (n - 1 - {LEVELS})::double) / sxx as std_error, n as n_obs, (select count(*) from s) as n_clusters, true as converged from b
""",
    "estimate std_error",
)
def _(v):
    fit = E.ols_hdfe(crossed(v), "y", ["x"], ["unit", "time"], ["cluster"])
    return fit.select("estimate", "std_error", "n_obs", "n_clusters", "converged")


# With an effect of each group and of each period, the model is saturated.
@query(
    "E11_ppml_saturated",
    """
with z as (select *, greatest(y - 145, 0) as k from did_panel)
select ln(avg(k) filter (where treated = 1 and post = 1) * avg(k) filter (where treated = 0 and post = 0) / (avg(k) filter (where treated = 1 and post = 0) * avg(k) filter (where treated = 0 and post = 1))) as estimate,
  count(*) as n_obs, count(*) filter (where k = 0) as n_zero, true as converged from z
""",
    "estimate:5",
)
def _(v):
    data = did_panel(v).withColumns(
        {"k": F.greatest(F.col("y") - 145, F.lit(0.0)), "did": F.col("treated") * F.col("post"), "cluster": F.col("unit")}
    )
    fit = E.ppml_hdfe(data, "k", ["did"], ["treated", "post"], ["cluster"])
    return fit.select("estimate", "n_obs", "n_zero", "converged")


@query("E11_ppml_hdfe")
def _(v):
    return E.ppml_hdfe(
        regression_panel(v), "value_k", ["log_tariff"], ["flow_id", "month_key"], ["hs10"]
    )


@query(
    "E12_event_dummies",
    """
with b as (select *, case when event_time < -2 then -3 when event_time > 2 then 3 else event_time end as k from panel)
select flow_id, month_key, cast(coalesce(k = -3, false) and is_treated_country as double) as evt_pre_bin_3, cast(coalesce(k = -2, false) and is_treated_country as double) as evt_m2,
       cast(coalesce(k = 0, false) and is_treated_country as double) as evt_p0, cast(coalesce(k = 1, false) and is_treated_country as double) as evt_p1,
       cast(coalesce(k = 2, false) and is_treated_country as double) as evt_p2, cast(coalesce(k = 3, false) and is_treated_country as double) as evt_post_bin_3 from b
""",
)
def _(v):
    out, names = X.event_dummies(panel_view(v), (-2, 2), -1)
    return out.select("flow_id", "month_key", *names)


@query("E12_event_study")
def _(v):
    return X.event_study(
        regression_panel(v), "log_customs_value", ["flow_id", "month_key"], ["hs10"], (-3, 3), -1
    )


@query("E12_exposure_event_study")
def _(v):
    panel = did_panel(v).withColumns(
        {"exposure": (F.col("unit") % 7).cast("double"), "year": F.year("time")}
    )
    return X.exposure_event_study(panel, "y", "exposure", "unit", "year", 1997)


@query(
    "E13_event_means",
    """
select event_time, is_treated_country, avg(log_customs_value) as mean, quantile_cont(log_customs_value, 0.5) as median, stddev_samp(log_customs_value) as sd, count(*) as n_obs
from panel where event_time between -12 and 12 and log_customs_value is not null group by 1, 2
""",
    "mean median sd",
)
def _(v):
    return X.event_means(panel_view(v), "log_customs_value")


COHORTS = {"A1": 1997 * 12 + 7, "A2": 1998 * 12 + 8, "A3": 1998 * 12 + 9}
cte(
    "cohort_panel",
    """
select *, case when cast(hs6 as integer) between 1 and 5 then 'A1' when cast(hs6 as integer) between 6 and 10 then 'A2' when cast(hs6 as integer) between 11 and 13 then 'A3' else 'NEVER_TREATED' end as treatment_cohort from panel
""",
)


def cohort_panel(v):
    k = F.col("hs6").try_cast("int")
    cohort = (
        F.when(k.between(1, 5), "A1")
        .when(k.between(6, 10), "A2")
        .when(k.between(11, 13), "A3")
        .otherwise("NEVER_TREATED")
    )
    return panel_view(v).drop("event_time").withColumn("treatment_cohort", cohort)


STACK = """
with w as (select * from (values ('A1', 23971), ('A2', 23984), ('A3', 23985)) c(g, m))
select hs10, country_code, month_date, g as stack_id, month_index - m as event_time, treatment_cohort = g and is_treated_country as stack_treated, flow_id || '@' || g as stack_flow
from cohort_panel p join w on month_index between m - 12 and m + 10 and (treatment_cohort = g or treatment_cohort = 'NEVER_TREATED'{extra}){where}
"""
for _name, _control, _extra, _where in (
    ("never", "never_treated_products", "", ""),
    ("country", "never_treated_products_treated_country_only", "", " where is_treated_country"),
    (
        "not_yet",
        "not_yet_treated",
        " or (case treatment_cohort when 'A1' then 23971 when 'A2' then 23984 when 'A3' then 23985 end) > m + 10",
        "",
    ),
):
    query(f"E14_stack_cohorts_{_name}", STACK.format(extra=_extra, where=_where))(
        lambda v, c=_control: X.stack_cohorts(cohort_panel(v), COHORTS, (-12, 10), c).select(
            "hs10", "country_code", "month_date", "stack_id", "event_time", "stack_treated", "stack_flow"
        )
    )


# Two waves of units over whole windows of quarters.
WAVES = {"A": 1996 * 4 + 1, "B": 1997 * 4 + 1}
cte(
    "wave_panel",
    "select *, year(time) * 4 + quarter(time) as qi, case when unit < 3 then 'A' when unit < 6 then 'B' else 'NEVER_TREATED' end as cohort from did_panel",
)
cte(
    "wave_stacks",
    f"""
select p.*, g, qi - m as k, cohort = g as mine from wave_panel p join (select * from (values ('A', {WAVES['A']}), ('B', {WAVES['B']})) w(g, m)) w on qi between m - 3 and m + 4 and cohort in (g, 'NEVER_TREATED')
""",
)


def wave_panel(v):
    unit = F.col("unit")
    return did_panel(v).withColumns(
        {
            "month_index": F.year("time") * 4 + F.quarter("time"),
            "treatment_cohort": F.when(unit < 3, "A").when(unit < 6, "B").otherwise("NEVER_TREATED"),
            "is_treated_country": F.lit(True),
            "flow_id": unit.cast("string"),
            "month_key": F.col("time").cast("string"),
            "hs10": unit.cast("string"),
        }
    )


def stacked_waves(v):
    return X.stacked_event_study(wave_panel(v), "y", WAVES, ["flow_id"], (-3, 4), -1)


@query(
    "E14_stacked_event_study",
    """
with m as (select g, k, avg(y) filter (where mine) - avg(y) filter (where not mine) as d, count(*) filter (where mine) as n1, count(*) filter (where not mine) as n0 from wave_stacks group by 1, 2),
c as (select a.k, a.d - b.d as d, a.n1 * a.n0 / (a.n1 + a.n0)::double as w from m a join m b on a.g = b.g and b.k = -1 where a.k <> -1)
select 'evt_' || case when k < 0 then 'm' else 'p' end || abs(k) as term, sum(w * d) / sum(w) as estimate, (select count(*) from wave_stacks) as n_obs, true as converged from c group by k
""",
    "estimate:5",
)
def _(v):
    fit, _ = stacked_waves(v)
    return fit.where(F.col("estimate").isNotNull()).select("term", "estimate", "n_obs", "converged")


@query(
    "E14_stack_composition",
    """
with w as (select * from (values ('A1', 23971), ('A2', 23984), ('A3', 23985)) c(g, m))
select g as stack_id, count(*) as n_obs, count(*) filter (where treatment_cohort = g and is_treated_country) as n_treated_obs, count(distinct hs10) as n_products, min(m) as treatment_month_index
from cohort_panel p join w on month_index between m - 12 and m + 10 and (treatment_cohort = g or treatment_cohort = 'NEVER_TREATED') group by 1
""",
)
def _(v):
    return X.stack_composition(X.stack_cohorts(cohort_panel(v), COHORTS, (-12, 10)))


def propagation_panel(v):
    return ppi_view(v).join(io_view(v), F.col("bea_industry") == F.col("industry_code"))


@query("E15_propagation")
def _(v):
    return X.pass_through(
        propagation_panel(v),
        "log_ppi",
        ["imported_input_cost_exposure", "downstream_total_requirements_exposure"],
        F.col("month_index") >= 1998 * 12 + 8,
        "bea_industry",
        "month_date",
    )


@query(
    "E15_pass_through",
    f"""
with d as (select {demeaned('y', 'y')}, {demeaned('e1 * post', 'a')}, {demeaned('e2 * post', 'b')} from crossed),
m as (select sum(a * a) as aa, sum(b * b) as bb, sum(a * b) as ab, sum(a * y) as ay, sum(b * y) as bv, count(*) as n from d)
select 'e1' as model, 'e1' as channel, ay / aa as estimate, n as n_obs, 20 as n_clusters, 199 as n_boot from m
union all select 'e2', 'e2', bv / bb, n, 20, 199 from m
union all select 'joint', 'e1', (ay * bb - bv * ab) / (aa * bb - ab * ab), n, 20, null from m
union all select 'joint', 'e2', (bv * aa - ay * ab) / (aa * bb - ab * ab), n, 20, null from m
""",
    "estimate:5",
)
def _(v):
    out = X.pass_through(crossed(v), "y", ["e1", "e2"], F.col("post") == 1, "unit", "time", 199)
    return out.select("model", "channel", "estimate", "n_obs", "n_clusters", "n_boot")


SIGN = H.format("cast(unit as varchar) || '|' || cast(r as varchar) || 'boot'")


@query(
    "E16_wild_bootstrap",
    f"""
with d as (select unit, {demeaned('y', 'y')}, {demeaned('treated * post', 'x')} from did_panel),
c as (select unit, sum(x * y) as b, sum(x * x) as g from d group by unit), t as (select sum(b) / sum(g) as beta, sum(g) as gram, count(*) as g, (select count(*) from d) as n from c),
o as (select beta, gram, g, n, sqrt((select sum(power(b - beta * c.g, 2)) from c, t) * (g / (g - 1)::double) * (n - 1) / (n - 1 - {LEVELS})::double) / gram as se from t),
s as (select unit, r, b * case when {SIGN} % 2 = 0 then 1 else -1 end as b, g from c, range(1, 1000) x(r)),
m as (select r, sum(b) / sum(g) as beta from s group by r), z as (select r, m.beta, sum(power(s.b - s.g * m.beta, 2)) as v from s join m using (r) group by 1, 2),
f as (select abs(z.beta / (sqrt(v * (o.g / (o.g - 1)::double) * (n - 1) / (n - 2)::double) / gram)) >= abs(o.beta / se) - 1e-9::double as hit from z, o)
select 'did' as term, beta as estimate, se as std_error, beta / se as t_observed, (select avg(cast(hit as double)) from f) as bootstrap_p_value, g as n_clusters, 999 as n_boot, true as converged from o
""",
    "estimate:5 std_error:5 t_observed:4 bootstrap_p_value",
)
def _(v):
    data = did_panel(v).withColumns(
        {"did": (F.col("treated") * F.col("post")).cast("double"), "cluster": F.col("unit")}
    )
    return E.wild_bootstrap(data, "y", ["did"], ["unit", "time"], "cluster").drop("analytic_p_value")


@query(
    "E06_estimator_ladder",
    f"""
select 'diff_in_means' as method, 'ok' as status, avg(y) filter (where treated = 1) - avg(y) filter (where treated = 0) as estimate, count(*) as n_obs from did_panel
union all select 'ols', 'ok', regr_slope(y, treated * post), count(*) from did_panel
union all select 'did', 'ok', {DID}, count(*) from did_panel
union all select 'ols_constant', 'not_applicable', null, 0 union all select 'synthetic_control', 'not_applicable', null, 0
""",
    "estimate:5",
)
def _(v):
    data = did_panel(v).withColumns({"d": F.col("treated") * F.col("post"), "one": F.lit(1.0)})
    rungs = {
        "diff_in_means": lambda df: E.diff_in_means(df, "y", "treated"),
        "ols": lambda df: E.ols(df, "y", ["d"], ["unit"]).where("term = 'd'"),
        "ols_constant": lambda df: E.ols(df, "y", ["one"]),
        "did": lambda df: E.did(df, "y", "unit", "time", "treated", "post"),
        "synthetic_control": lambda df: E.synthetic_control(df, "unit", "time", "y", "99", "1998-07-01"),
    }
    return X.estimate_ladder(data, rungs).select("method", "status", "estimate", "n_obs")


@query("E17_aipw")
def _(v):
    return E.aipw(units(v), "y", "t", ["x", "h"], "id", cluster="g", folds=4)


# One two-valued covariate: propensities and outcome models are means of the other folds' cells.
@query(
    "E17_aipw_two_cells",
    f"""
with u as (select y::double as y, t, cast(h <= 6 as integer) as b, g, {H.format("cast(g as varchar) || 'fold'")} % 4 as f from units),
m as (select k.f, b, avg(t) as p, avg(y) filter (where t = 1) as m1, avg(y) filter (where t = 0) as m0 from u join (select distinct f from u) k on u.f <> k.f group by 1, 2),
s as (select g, m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) as psi from (select u.*, m1, m0, least(greatest(p, 0.02), 0.98) as e from u join m using (f, b)) q),
z as (select avg(psi) as mean, count(*) as n from s), c as (select g, sum(psi - mean) as i, max(mean) as mean, max(n) as n from s, z group by g)
select max(mean) as estimate, sqrt(sum(i * i) / (max(n)::double * max(n)) * (count(*) / (count(*) - 1)::double)) as standard_error, max(n) as n_obs, count(*) as n_clusters, 4 as folds from c
""",
    "estimate:4 standard_error:4",
)
def _(v):
    data = units(v).withColumn("b", (F.col("h") <= 6).cast("int"))
    return E.aipw(data, "y", "t", ["b"], "id", cluster="g", folds=4)


@query(
    "E18_t_learner_one_covariate",
    f"""
with u as (select id, y::double as y, t, x::double as x, {H.format("cast(id as varchar) || 'fold'")} % 3 as f from units),
m as (select k.f, t, regr_slope(y, x) as s, regr_intercept(y, x) as a from u join (select distinct f from u) k on u.f <> k.f group by 1, 2),
d as (select f, sum(case when t = 1 then s else -s end) as s, sum(case when t = 1 then a else -a end) as a from m group by f)
select id, d.a + d.s * x as estimated_effect from u join d using (f)
""",
    "estimated_effect:4",
)
def _(v):
    return E.t_learner(units(v), "y", "t", ["x"], "id", folds=3).select("id", "estimated_effect")


@query("E18_t_learner")
def _(v):
    out = E.t_learner(units(v), "y", "t", ["x", "h"], "id", folds=3)
    return out.select("id", "x", "h", "estimated_effect")


@query("E18_s_learner")
def _(v):
    out = E.s_learner(units(v), "y", "t", ["x", "h"], "id", folds=2)
    return out.select("id", "x", "h", "estimated_effect")


@query("E19_synthetic_control")
def _(v):
    return E.synthetic_control(did_panel(v), "unit", "time", "y", "3", "1998-07-01")


# Unit 0 made a mix of units 8 and 11 before the date: the optimum is that mix.
@query(
    "E19_synthetic_control_of_a_mix",
    """
with m as (select time, 0.7::double * max(y) filter (where unit = 8) + 0.3::double * max(y) filter (where unit = 11) as s, max(post) as post from did_panel group by time)
select time, s + 12 * post as treated, s as synthetic, 12.0::double * post as gap, post, 19 as n_donors, true as converged from m
""",
    "treated:4 synthetic:4 gap:4",
)
def _(v):
    panel = did_panel(v)
    weight = F.when(F.col("unit") == 8, 0.7).when(F.col("unit") == 11, 0.3)
    mixed = panel.where(F.col("unit").isin(8, 11)).groupBy("time").agg(
        (F.sum(F.col("y") * weight) + 12 * F.max("post")).alias("mix")
    )
    panel = panel.join(mixed, "time").withColumn(
        "y", F.when(F.col("unit") == 0, F.col("mix")).otherwise(F.col("y"))
    )
    out = E.synthetic_control(panel, "unit", "time", "y", "0", "1998-07-01")
    return out.select("time", "treated", "synthetic", "gap", "post", "n_donors", "converged")


@query("E20_exposure_response")
def _(v):
    exposed = MB.neighbor_exposure(assign_view(v), edges_view(v), history_lags=1)
    zone = F.col("zone_id").try_cast("int")
    base = (hash32("zone_id", "period_id") % 1000) / 1000.0
    data = exposed.withColumn(
        "outcome", 2.0 * F.col("treatment") + F.col("neighbor_exposure") + base + zone / 10
    ).withColumn("randomization_cluster", F.floor(zone / 5))
    return X.exposure_response(data)


CELLS = {
    "baseline": "true",
    "large_orders": "abs(hash_x) % 3 > 0",
    "recent_years": "time >= date '1996-07-01'",
    "half_units": "unit % 2 = 0",
}


def grid_cells(v):
    panel = did_panel(v).withColumn("hash_x", F.col("unit") * 7 + F.year("time"))
    tagged = X.robustness_cells(panel, {n: F.expr(e) for n, e in CELLS.items()})
    return X.grouped_did(tagged, ["cell"], "y", "treated", "post", "unit")


@query(
    "E21_robustness",
    """
with p as (select *, unit * 7 + year(time) as hash_x from did_panel),
c as ("""
    + " union all ".join(f"select *, '{n}' as cell from p where {e}" for n, e in CELLS.items())
    + """),
m as (select cell, treated, post, avg(y) as m, count(*) as n from c group by 1, 2, 3),
e as (select cell, sum(case when treated = post then m else -m end) as estimate, cast(sum(n) as bigint) as n_obs from m group by 1),
i as (select c.cell, c.unit, sum(case when treated = post then 1 else -1 end * (y - m) / n) as i from c join m using (cell, treated, post) group by 1, 2),
s as (select cell, sqrt(sum(i * i) * count(*) / (count(*) - 1)::double) as std_error, count(*) as n_clusters from i group by 1)
select e.cell, estimate, n_obs, std_error, n_clusters, case when std_error <= 0 then 'not_estimable' when abs(estimate / std_error) < 1.6448536269514722 then 'insignificant'
  when estimate * (select estimate from e where cell = 'baseline') < 0 then 'sign_flip' when abs(estimate) < 0.5 * abs((select estimate from e where cell = 'baseline')) then 'attenuated' else 'consistent' end as verdict
from e join s using (cell)
""",
    "estimate:5 std_error:5",
)
def _(v):
    return X.verdicts(grid_cells(v), "baseline")


@query(
    "E22_placebo_panels",
    """
with r as (select min(first_treated_month_index) as m from panel)
select flow_id, month_key, s as shift, cast(month_index >= m - s as integer) as post from panel, r, (values (6), (12)) x(s) where month_index < m
""",
)
def _(v):
    out = X.placebo_panels(panel_view(v), (6, 12), "first_treated_month_index")
    return out.select("flow_id", "month_key", "shift", "post")


@query("E22_placebo_dates")
def _(v):
    panel = X.placebo_panels(panel_view(v), (6, 12), "first_treated_month_index")
    panel = panel.withColumn("mine", F.col("is_treated_country").cast("int"))
    return X.grouped_did(panel, ["shift"], "log_customs_value", "mine", "post", "hs10")


@query("E22_placebo_products")
def _(v):
    fake = X.placebo_products(panel_view(v), "hs10", 0.5, "fake").withColumn("cell", F.lit("fake"))
    return X.grouped_did(fake, ["cell"], "log_customs_value", "fake_treated", "post", "hs10")


# --- Monte Carlo and allocation ---------------------------------------------------

MC = """
select {k}, avg(truth) as truth, avg(estimate) as mean_estimate, avg(estimate - truth) as bias, stddev_samp(estimate - truth) / sqrt(count(*)) as bias_mcse, var_samp(estimate) as variance,
  sqrt(avg(power(estimate - truth, 2))) as rmse, stddev_samp(power(estimate - truth, 2)) / sqrt(count(*)) / (2 * sqrt(avg(power(estimate - truth, 2)))) as rmse_mcse,
  avg(cast(c as double)) as coverage, sqrt((s + 0.5) * (count(*) - s + 0.5) / (power(count(*) + 1, 2) * (count(*) + 2))) as coverage_mcse,
  avg(cast(r as double)) as power, sqrt((q + 0.5) * (count(*) - q + 0.5) / (power(count(*) + 1, 2) * (count(*) + 2))) as power_mcse,
  avg(std_error) as mean_std_error, count(*) as replications, avg(power(estimate - truth, 2)) as information_cost
from (select *, sum(cast(c as double)) over (partition by {k}) as s, sum(cast(r as double)) over (partition by {k}) as q from (
  select *, estimate - 1.959963984540054 * std_error <= truth and truth <= estimate + 1.959963984540054 * std_error as c, abs(estimate / std_error) > 1.959963984540054 as r from mc_records) z) y
group by {k}, s, q
"""
MC_DIGITS = "truth mean_estimate bias:8 bias_mcse:8 variance:9 rmse:8 rmse_mcse:9 coverage coverage_mcse:8 power power_mcse:8 mean_std_error:7 information_cost:9"
cte("mc_summary", MC.format(k="design, estimator, scenario"))


cte("mc_wide", "select * replace (std_error * case when estimator = 'F' then 1.5::double else 1.0::double end as std_error) from mc_records")
cte("mc_wide_summary", MC.format(k="design, estimator, scenario").replace("from mc_records", "from mc_wide"))


@query("A43_monte_carlo", MC.format(k="design, estimator"), MC_DIGITS)
def _(v):
    return X.summarize_monte_carlo(v.mc_records, ["design", "estimator"])


@query(
    "A43_best_design",
    """
select scenario, design, estimator, rmse, information_cost from (select *, row_number() over (partition by scenario order by rmse, information_cost, design, estimator) as rn from mc_summary) x where rn = 1
""",
    "scenario:3 rmse:8 information_cost:9",
)
def _(v):
    summary = X.summarize_monte_carlo(v.mc_records, ["design", "estimator", "scenario"])
    return X.best_design(summary, ["scenario"])


@query(
    "K04_minimax",
    """
with s as (select *, abs(coverage - 0.95) as gap, rmse * (1 + 2 * abs(coverage - 0.95)) as score, coverage + 2 * coverage_mcse >= 0.95 - 0.10 as ok from mc_wide_summary),
w as (select design, estimator, bool_and(ok) as ok, count(distinct scenario) as n_scenarios, max(score) as decision_score, arg_max(gap, score) as coverage_gap, arg_max(power, score) as power from s group by 1, 2)
select design, estimator, n_scenarios, decision_score, coverage_gap, power from w where ok and n_scenarios = (select count(distinct scenario) from s)
order by decision_score, coverage_gap, power desc, design, estimator limit 1
""",
    "decision_score:7 coverage_gap power",
)
def _(v):
    # one estimator reports errors wide enough for its intervals to cover
    wide = F.when(F.col("estimator") == "F", 1.5).otherwise(1.0)
    records = v.mc_records.withColumn("std_error", F.col("std_error") * wide)
    summary = X.summarize_monte_carlo(records, ["design", "estimator", "scenario"])
    return X.minimax(summary, "scenario")


@query(
    "A44_subgroup_summary",
    """
with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from orders)
select cast(case when o_totalprice <= a then 0 when o_totalprice <= b then 1 when o_totalprice <= c then 2 else 3 end as integer) as modifier_bin, min(o_totalprice) as modifier_min,
       max(o_totalprice) as modifier_max, avg(o_custkey % 100) as mean_estimated_effect, stddev_samp(o_custkey % 100) as sd_estimated_effect, count(*) as rows from orders, q group by 1
""",
    "modifier_min:2 modifier_max:2 mean_estimated_effect:4 sd_estimated_effect:4",
)
def _(v):
    df = v.orders.select("o_totalprice", (F.col("o_custkey") % 100).alias("effect"))
    return X.subgroup_summary(df, "o_totalprice", "effect", 4)


@query(
    "A45_fit_ledger",
    """
with p as (select distinct l_returnflag as design, l_linestatus as estimator, l_returnflag <> 'N' as identified from lineitem union all select 'Z', 'F', true),
d as (select design, estimator, count(*) filter (where std_error < 0.026) as ok, avg(cast(scenario > 0 as double)) as iv from mc_records group by 1, 2)
select p.design, p.estimator, identified, cast(20000 as bigint) as attempted_fits, coalesce(ok, 0) as successful_fits, coalesce(iv, 0) as inference_valid_rate, 20000 - coalesce(ok, 0) as failed_fits,
       20000 = coalesce(ok, 0) as fit_complete, coalesce(ok, 0) / 20000.0::double as fit_success_rate, identified and 20000 = coalesce(ok, 0) and coalesce(iv, 0) = 1 as decision_eligible
from p left join d on p.design = d.design and p.estimator = d.estimator
""",
    "inference_valid_rate fit_success_rate",
)
def _(v):
    flag = F.col("l_returnflag")
    plans = v.lineitem.select(
        flag.alias("design"), F.col("l_linestatus").alias("estimator"), (flag != "N").alias("identified")
    ).distinct()
    extra = plans.limit(1).select(
        F.lit("Z").alias("design"), F.lit("F").alias("estimator"), F.lit(True).alias("identified")
    )
    records = v.mc_records.withColumns(
        {
            "fit_status": F.when(F.col("std_error") < 0.026, "ok").otherwise("failed"),
            "inference_valid": F.col("scenario") > 0,
        }
    )
    return X.fit_ledger(plans.unionByName(extra), records, ["design", "estimator"], 20000)


cte(
    "items",
    """
select o_orderkey as item, o_custkey % 50 as market, o_totalprice / 1000 as cost, (o_orderkey * 37 % 1000) - 200 as score from orders
""",
)


def items(v):
    k = F.col("o_orderkey")
    return v.orders.select(
        k.alias("item"),
        (F.col("o_custkey") % 50).alias("market"),
        (F.col("o_totalprice") / 1000).alias("cost"),
        (k * 37 % 1000 - 200).cast("double").alias("score"),
    )


@query(
    "W11_ranked_plan",
    """
with r as (select *, sum(cost) over (partition by market order by score / cost desc, item rows between unbounded preceding and current row) as run from items where score > 0)
select item, market, cost, cast(score as double) as score, cast(run - cost < 1.1::double * 5000 as integer) as selected from r
""",
    "cost:3 score:1",
)
def _(v):
    return W.ranked_plan(items(v), ["market"], "score", "cost", "item", F.lit(1.1 * 5000))


@query(
    "W12_allocate_ranked",
    """
with recursive r as (select *, row_number() over (partition by market order by score / cost desc, item) as rk from items where score > 0),
w as (select market, item, rk, cost <= 5000 + 1e-12::double as took, case when cost <= 5000 + 1e-12::double then cost else 0 end as spent from r where rk = 1
  union all select r.market, r.item, r.rk, w.spent + r.cost <= 5000 + 1e-12::double, w.spent + case when w.spent + r.cost <= 5000 + 1e-12::double then r.cost else 0 end
  from w join r on r.market = w.market and r.rk = w.rk + 1)
select i.item, i.market, i.cost, cast(i.score as double) as score, cast(coalesce(w.took, false) as integer) as selected from items i left join w using (market, item)
""",
    "cost:3 score:1",
)
def _(v):
    return W.allocate_ranked(items(v), "market", "score", "cost", "item", F.lit(5000.0))


@query(
    "A46_score_allocations",
    """
with a as (select market % 3 as policy, cost, cast(score as double) as effect, cast(item % 4 = 0 as double) as allocation from items)
select policy, sum(allocation * effect) as expected_incremental_outcome, sum(allocation * cost) as budget_spent, 100000.0::double as budget,
       case when sum(allocation * cost) > 0 then sum(allocation * effect) / sum(allocation * cost) else 0 end as budget_efficiency, sum(allocation) as selected_equivalent_units,
       avg(allocation) as selected_share, count(*) as holdout_rows from a group by 1
""",
    "expected_incremental_outcome:1 budget_spent:2 budget:1 budget_efficiency selected_equivalent_units:1 selected_share",
)
def _(v):
    df = items(v).select(
        (F.col("market") % 3).alias("policy"),
        "cost",
        F.col("score").alias("effect"),
        (F.col("item") % 4 == 0).cast("double").alias("allocation"),
    )
    return X.score_allocations(df, 100000.0)


