"""Queries over the trade panel."""

from pyspark.sql import functions as F

from quaymetrics.core import ratio
from quaymetrics.functions.columns import stage_trade, value_measures
from quaymetrics.operators import mobility as MB
from quaymetrics.operators import trade as TD
from quaymetrics.plans.policy import TREATED, panel_view
from quaymetrics.registry import cte, query


@query(
    "A21_rollup_product",
    """
select substr(hs10, 1, 6) as hs6, country_code, month_date, sum(con_val_mo) as con_val_mo, sum(dut_val_mo) as dut_val_mo, sum(cal_dut_mo) as cal_dut_mo,
       sum(con_cha_mo) as con_cha_mo, case when count(distinct nullif(unit_qy1, '')) = 1 then sum(con_qy1_mo) end as con_qy1_mo,
       case when count(distinct nullif(unit_qy1, '')) = 1 then min(nullif(unit_qy1, '')) else '' end as unit_qy1, count(*) as n_hs10_lines,
       count(distinct nullif(unit_qy1, '')) > 1 as hs6_units_mixed
from staged group by 1, 2, 3
""",
    "con_val_mo:2 dut_val_mo:2 cal_dut_mo:4 con_cha_mo:4 con_qy1_mo:1",
)
def _(v):
    return TD.rollup_product(stage_trade(v.trade))


def values(v):
    return value_measures(stage_trade(v.trade))


@query(
    "A22_sourcing_measures",
    "select hs10, country_code, month_date, product_month_total_value, supplier_count_in_sample, supplier_hhi_in_sample, treated_country_share, supplier_value_share, alternative_source_share, is_treated_country from panel",
    "product_month_total_value:2 supplier_hhi_in_sample treated_country_share supplier_value_share alternative_source_share",
)
def _(v):
    return TD.sourcing_measures(values(v), TREATED).select(
        "hs10",
        "country_code",
        "month_date",
        "product_month_total_value",
        "supplier_count_in_sample",
        "supplier_hhi_in_sample",
        "treated_country_share",
        "supplier_value_share",
        "alternative_source_share",
        "is_treated_country",
    )


@query(
    "A23_pre_exposure",
    "select distinct hs10, pretreatment_treated_country_share from panel",
    "pretreatment_treated_country_share",
)
def _(v):
    out = TD.pre_exposure(values(v), TREATED, "1997-06-30")
    return out.select("hs10", "pretreatment_treated_country_share").distinct()


@query(
    "A24_event_time",
    "select hs10, country_code, month_date, month_index, first_treated_month_index, event_time, ever_treated_product from panel",
)
def _(v):
    return panel_view(v).select(
        "hs10",
        "country_code",
        "month_date",
        "month_index",
        "first_treated_month_index",
        "event_time",
        "ever_treated_product",
    )


@query(
    "A25_monthly_aggregates",
    """
select month_date, is_treated_country, sum(customs_value) as customs_value, sum(quantity) as quantity, sum(calculated_duties) as calculated_duties, sum(dutiable_value) as dutiable_value,
       count(distinct hs6) as n_products, case when sum(dutiable_value) > 0 then sum(calculated_duties) / sum(dutiable_value) end as trade_weighted_realised_duty_rate,
       case when sum(quantity) > 0 then sum(customs_value) / sum(quantity) end as aggregate_customs_unit_value
from panel group by 1, 2
""",
    "customs_value:2 quantity:1 calculated_duties:3 dutiable_value:2 trade_weighted_realised_duty_rate aggregate_customs_unit_value:4",
)
def _(v):
    return TD.monthly_aggregates(panel_view(v))


@query(
    "A25_treated_share",
    """
select month_date, ever_treated_product, sum(customs_value) as total_value, sum(case when country_code = '3' then customs_value else 0 end) as treated_country_value,
       sum(case when country_code = '3' then customs_value else 0 end) / sum(customs_value) as treated_country_share from panel group by 1, 2
""",
    "total_value:2 treated_country_value:2 treated_country_share",
)
def _(v):
    return TD.treated_share(panel_view(v), TREATED)


@query(
    "A25_weighted_tariff",
    "select month_date, sum(additional_tariff_rate * customs_value) / sum(customs_value) as trade_weighted_additional_tariff, sum(customs_value) as customs_value from panel where country_code = '3' group by 1",
    "trade_weighted_additional_tariff customs_value:2",
)
def _(v):
    return TD.weighted_tariff(panel_view(v), TREATED)


@query(
    "A25_concentration",
    """
select month_date, ever_treated_product, avg(supplier_hhi_in_sample) as mean_supplier_hhi_in_sample, avg(supplier_count_in_sample) as mean_supplier_count,
       count(*) filter (where flow_entry) as flow_entries, count(*) filter (where flow_exit) as flow_exits from panel group by 1, 2
""",
    "mean_supplier_hhi_in_sample mean_supplier_count",
)
def _(v):
    return TD.concentration(panel_view(v))


@query(
    "A25_sector_table",
    """
select substr(hs10, 6, 1) as sector, count(distinct hs6) as n_products, avg(cast(ever_treated_product as double)) as share_products_treated,
       avg(pretreatment_treated_country_share) as mean_pretreat_dependence, sum(customs_value) as customs_value from panel group by 1
""",
    "share_products_treated mean_pretreat_dependence customs_value:1",
)
def _(v):
    return TD.sector_table(panel_view(v), F.substring("hs10", 6, 1))


@query(
    "W06_extensive_margin",
    """
with s as (select hs10, country_code, month_date, case when month(month_date) % 5 = 0 then null when hs10 like '%7' then 0 else con_val_mo end as customs_value from trade)
select hs10, country_code, month_date, a as flow_active, lag(a) over w as flow_active_lag, a and not coalesce(lag(a) over w, false) as flow_entry,
       not a and coalesce(lag(a) over w, false) as flow_exit
from (select *, coalesce(customs_value, 0) > 0 as a from s) x window w as (partition by hs10, country_code order by month_date)
""",
)
def _(v):
    gaps = (
        F.when(F.month("month_date") % 5 == 0, F.lit(None))
        .when(F.col("hs10").like("%7"), 0.0)
        .otherwise(F.col("con_val_mo"))
    )
    df = v.trade.select("hs10", "country_code", "month_date", gaps.alias("customs_value"))
    return TD.extensive_margin(df).drop("customs_value")


# --- decompositions ---------------------------------------------------------------

cte(
    "margins",
    """
select hs6, country_code, coalesce(avg(case when event_time between -12 and -1 then coalesce(customs_value, 0) end), 0) as pre_value,
       coalesce(avg(case when event_time between 1 and 10 then coalesce(customs_value, 0) end), 0) as post_value,
       coalesce(bool_or(case when event_time between -12 and -1 then coalesce(customs_value, 0) > 0 end), false) as pre_active,
       coalesce(bool_or(case when event_time between 1 and 10 then coalesce(customs_value, 0) > 0 end), false) as post_active
from panel where event_time between -12 and -1 or event_time between 1 and 10 group by 1, 2
""",
)
cte(
    "decomposed",
    """
with m as (select *, country_code = '3' as t, post_value - pre_value as d, pre_active and post_active as i, pre_active <> post_active as e from margins),
g as (select hs6, sum(case when t and i then d else 0 end) as treated_intensive, sum(case when t and e then d else 0 end) as treated_extensive,
             sum(case when not t and i then d else 0 end) as alternative_intensive, sum(case when not t and e then d else 0 end) as alternative_extensive,
             sum(d) as total_change, sum(case when t then pre_value else 0 end) as pre_treated_value, sum(case when not t then pre_value else 0 end) as pre_alternative_value,
             sum(pre_value) as pre_total_value, sum(post_value) as post_total_value, count(*) filter (where not t and e and post_active) as n_alt_suppliers_entered,
             count(*) filter (where not t and e and pre_active) as n_alt_suppliers_exited, count(*) filter (where t and e and pre_active) as n_treated_flows_exited from m group by 1)
select *, treated_intensive + treated_extensive as treated_total, alternative_intensive + alternative_extensive as alternative_total from g
""",
)
RATIOS = (
    "case when pre_treated_value > 0 then treated_total / pre_treated_value end as treated_pct_change, "
    "case when treated_total < 0 then -alternative_total / treated_total end as replacement_ratio"
)
DECOMPOSED_DIGITS = (
    "treated_intensive:3 treated_extensive:3 alternative_intensive:3 alternative_extensive:3 total_change:3 pre_treated_value:3 pre_alternative_value:3 pre_total_value:3 "
    "post_total_value:3 treated_total:3 alternative_total:3 treated_pct_change replacement_ratio:5"
)


@query("A26_decompose", f"select *, {RATIOS} from decomposed", DECOMPOSED_DIGITS)
def _(v):
    return TD.decompose(panel_view(v), TREATED)


SUMS = (
    "treated_intensive treated_extensive alternative_intensive alternative_extensive total_change pre_treated_value pre_alternative_value pre_total_value post_total_value treated_total alternative_total"
).split()
COUNTS = "n_alt_suppliers_entered n_alt_suppliers_exited n_treated_flows_exited".split()
cte(
    "decomposed_totals",
    "select "
    + ", ".join(f"sum({c}) as {c}" for c in SUMS)
    + ", "
    + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in COUNTS)
    + " from decomposed",
)


@query(
    "A26_decompose_totals", f"select *, {RATIOS} from decomposed_totals", DECOMPOSED_DIGITS.replace(":3", ":2")
)
def _(v):
    return TD.decompose_totals(TD.decompose(panel_view(v), TREATED))


@query(
    "A27_decompose_adjusted",
    """
with t as (select * from panel where ever_treated_product),
mo as (select month_index, bool_or(event_time <= -1) as pre, bool_or(event_time >= 1) as post from t where event_time between -12 and 10 group by 1),
gr as (select country_code, avg(case when post then coalesce(customs_value, 0) end) / nullif(avg(case when pre then coalesce(customs_value, 0) end), 0) as growth
       from panel p join mo using (month_index) where not ever_treated_product group by 1),
c as (select m.*, g.growth, pre_value * growth as cf from margins m left join gr g on m.country_code = g.country_code)
select country_code, sum(pre_value) as pre_monthly_value, sum(post_value) as post_monthly_value, sum(cf) as counterfactual_post_value, sum(post_value - cf) as excess_change,
       max(growth) as control_growth_factor, country_code = '3' as is_treated_country, case when sum(cf) > 0 then sum(post_value - cf) / sum(cf) end as excess_pct_vs_counterfactual
from c group by country_code
""",
    "pre_monthly_value:2 post_monthly_value:2 counterfactual_post_value:2 excess_change:2 control_growth_factor excess_pct_vs_counterfactual",
)
def _(v):
    return TD.decompose_adjusted(panel_view(v), TREATED)


@query(
    "A28_country_gains",
    """
with g as (select country_code, sum(pre_value) as a, sum(post_value) as b from margins group by 1)
select country_code, a as pre_monthly_value, b as post_monthly_value, b - a as change, case when a > 0 then (b - a) / a end as pct_change, country_code = '3' as is_treated_country,
       a / sum(a) over () as pre_share, b / sum(b) over () as post_share, b / sum(b) over () - a / sum(a) over () as share_change from g
""",
    "pre_monthly_value:2 post_monthly_value:2 change:2 pct_change pre_share post_share share_change",
)
def _(v):
    return TD.country_gains(panel_view(v), TREATED)


@query(
    "A28_split_by_dependence",
    f"""
with dep as (select hs6, coalesce(sum(case when country_code = '3' then customs_value end), 0) / nullif(sum(customs_value), 0) as dependence from panel where event_time between -12 and -1 group by 1),
j as (select d.*, {RATIOS}, dependence from decomposed d join dep using (hs6) where dependence is not null),
m as (select quantile_cont(dependence, 0.5) as cut from j)
select case when dependence > cut then 'high_dependence' else 'low_dependence' end as dependence_group, count(*) as n_products, sum(treated_total) as treated_change,
       sum(alternative_total) as alternative_change, sum(pre_treated_value) as pre_treated_value, quantile_cont(replacement_ratio, 0.5) as median_replacement_ratio,
       sum(treated_total) / nullif(sum(pre_treated_value), 0) as treated_pct_change
from j, m group by 1
""",
    "treated_change:2 alternative_change:2 pre_treated_value:2 median_replacement_ratio:5 treated_pct_change",
)
def _(v):
    panel = panel_view(v)
    return TD.split_by_dependence(panel, TD.decompose(panel, TREATED), TREATED)


@query(
    "J07_full_pre_post",
    """
with a as (select hs10, country_code, sum(con_val_mo) as v from trade where year(month_date) = 1996 group by 1, 2),
b as (select hs10, country_code, sum(con_val_mo) as v from trade where year(month_date) = 2000 group by 1, 2)
select coalesce(a.hs10, b.hs10) as hs10, coalesce(a.country_code, b.country_code) as country_code, coalesce(a.v, 0) as pre_value, coalesce(b.v, 0) as post_value
from a full join b on a.hs10 = b.hs10 and a.country_code = b.country_code
""",
    "pre_value:2 post_value:2",
)
def _(v):
    def window(year):
        return (
            v.trade.where(F.year("month_date") == year)
            .groupBy("hs10", "country_code")
            .agg(F.sum("con_val_mo").alias("v"))
        )

    return TD.full_pre_post(window(1996), window(2000), ["hs10", "country_code"], "v")


# --- industry exposure ------------------------------------------------------------

cte("commodity_map", "select distinct case when cast(hs6 as integer) = 17 then 'x' else '' end || hs6 as hs6, cast(cast(hs6 as integer) % 9 as varchar) as commodity_code from trade")
cte(
    "commodity",
    """
with p as (select hs6, sum(case when month_index <= 1997 * 12 + 6 then customs_value end) as w, max(additional_tariff_rate) as peak from panel group by 1),
j as (select p.*, m.commodity_code from p left join commodity_map m on p.hs6 = m.hs6 where w is not null)
select commodity_code, sum(peak * w) / sum(w) as commodity_tariff_exposure, sum(w) as pre_import_value, count(*) as n_products, count(*) filter (where peak > 0) as n_treated_products,
       (select count(*) from j where commodity_code is null) as n_unmapped_products
from j where commodity_code is not null group by 1
""",
)


def commodity_view(v):
    k = F.col("hs6").try_cast("int")
    renamed = F.concat(F.when(k == 17, "x").otherwise(""), "hs6")
    mapping = v.trade.select("hs6").distinct().select(
        renamed.alias("hs6"), (k % 9).cast("string").alias("commodity_code")
    )
    return TD.commodity_exposure(panel_view(v), mapping, 1997 * 12 + 6)


@query("A29_commodity_exposure", "select * from commodity", "commodity_tariff_exposure pre_import_value:1")
def _(v):
    return commodity_view(v)


cte(
    "requirements",
    """
select origin_zone_id as industry_code, destination_zone_id as commodity_code, trip_count::double / sum(trip_count) over (partition by origin_zone_id) as direct_requirement,
       1.3::double * trip_count / sum(trip_count) over (partition by origin_zone_id) + case when origin_zone_id = destination_zone_id then 1 else 0 end as total_requirement
from flows
""",
)


def requirements(v):
    flows = MB.od_month(MB.od_flow(v.trips, 1440))
    shared = MB.with_share(flows, ["origin_zone_id"], "trip_count", "direct_requirement")
    own = F.when(F.col("origin_zone_id") == F.col("destination_zone_id"), 1.0).otherwise(0.0)
    return shared.select(
        F.col("origin_zone_id").alias("industry_code"),
        F.col("destination_zone_id").alias("commodity_code"),
        "direct_requirement",
        (1.3 * F.col("direct_requirement") + own).alias("total_requirement"),
    )


cte(
    "io_exposure",
    """
with c as (select industry_code, sum(direct_requirement * commodity_tariff_exposure) as cost, sum(total_requirement * commodity_tariff_exposure) as down from requirements join commodity using (commodity_code) group by 1),
x as (select i.industry_code, coalesce(e.commodity_tariff_exposure, 0) as output_protection_exposure, coalesce(cost, 0) as imported_input_cost_exposure,
             coalesce(down, 0) as downstream_total_requirements_exposure
      from (select distinct industry_code from requirements) i left join commodity e on e.commodity_code = i.industry_code left join c on c.industry_code = i.industry_code)
select *, case when output_protection_exposure > 0.01 and imported_input_cost_exposure > 0.005 then 'BOTH_PROTECTED_AND_COST_EXPOSED' when output_protection_exposure > 0.01 then 'PROTECTED_ONLY'
               when imported_input_cost_exposure > 0.005 then 'INPUT_COST_EXPOSED_ONLY' else 'LITTLE_DIRECT_EXPOSURE' end as exposure_class
from x
""",
)


def io_view(v):
    m = requirements(v)
    return TD.io_exposure(
        commodity_view(v), m.drop("total_requirement"), m.drop("direct_requirement")
    )


@query(
    "A30_io_exposure",
    "select * from io_exposure",
    "output_protection_exposure imported_input_cost_exposure downstream_total_requirements_exposure",
)
def _(v):
    return io_view(v)


cte(
    "ppi",
    """
with o as (select hs6 as naics, month_date, sum(con_val_mo) / nullif(sum(con_qy1_mo), 0) as index_value from trade group by 1, 2)
select cast(cast(naics as integer) % 5 as varchar) as bea_industry, month_date, avg(index_value) as ppi_index, count(distinct naics) as n_component_series,
       ln(avg(index_value)) as log_ppi, year(month_date) * 12 + month(month_date) as month_index
from o group by 1, 2
""",
)


def ppi_view(v):
    k = F.col("hs6").try_cast("int")
    obs = v.trade.groupBy(F.col("hs6").alias("naics"), "month_date").agg(
        ratio(F.sum("con_val_mo"), F.sum("con_qy1_mo")).alias("index_value")
    )
    link = (
        v.trade.select("hs6")
        .distinct()
        .select((k % 5).cast("string").alias("bea_industry"), F.col("hs6").alias("naics"))
    )
    return TD.industry_index(obs, link)


@query("A31_industry_index", "select * from ppi", "ppi_index:4 log_ppi")
def _(v):
    return ppi_view(v)


@query(
    "A40_shortfall_bound",
    """
with d as (select *, total_modeled_tariff_rate - realised_duty_rate_on_dutiable as gap from panel
           where is_treated_country and additional_tariff_rate > 0 and dutiable_value > 0 and customs_value > 0)
select month_date, count(*) as n_obs, count(*) filter (where gap > 0.03) as n_short, sum(customs_value) as customs_value, sum(case when gap > 0.03 then customs_value else 0 end) as customs_value_short,
       quantile_cont(gap, 0.5) as median_gap, (count(*) filter (where gap > 0.03)) / count(*)::double as share_obs_short, sum(case when gap > 0.03 then customs_value else 0 end) / sum(customs_value) as share_value_short
from d group by 1
""",
    "customs_value:2 customs_value_short:2 median_gap share_obs_short share_value_short",
)
def _(v):
    return TD.shortfall_bound(panel_view(v))


# --- sourcing counterfactual ------------------------------------------------------

SIGMAS = (1.0, 1.5, 2.0, 4.0)
cte(
    "shares",
    """
with c as (select hs10, country_code, sum(case when event_time < 0 then customs_value end) as pre, sum(case when event_time >= 0 then customs_value end) as post,
                  avg(case when event_time >= 0 then additional_tariff_rate end) as tau from panel group by 1, 2),
s as (select *, sum(pre) over (partition by hs10) as a, sum(post) over (partition by hs10) as b, sum(case when country_code = '3' then pre end) over (partition by hs10) as mine from c)
select hs10, country_code, pre as pre_value, pre / nullif(a, 0) as share_pre, coalesce(post / nullif(b, 0), 0) as share_post, coalesce(tau, 0) as tariff_change from s where pre is not null and mine > 0
""",
)
cte(
    "ces",
    """
with g as (select s.*, sigma, share_pre * power(1 + tariff_change, 1 - sigma) as w from shares s, (select unnest([1.0, 1.5, 2.0, 4.0])::double as sigma) x),
t as (select *, sum(w) over (partition by hs10, sigma) as sw, sum(share_pre * ln(1 + tariff_change)) over (partition by hs10, sigma) as geo from g)
select hs10, country_code, pre_value, share_pre, share_post, tariff_change, sigma, w / sw as share_counterfactual, w / sw - share_pre as share_change,
       case when sigma = 1 then geo else ln(sw) / nullif(1 - sigma, 0) end as log_price_index_change, exp(case when sigma = 1 then geo else ln(sw) / nullif(1 - sigma, 0) end) as price_index_change
from t
""",
)


def ces_view(v):
    return TD.ces_counterfactual(TD.pre_post_shares(panel_view(v), TREATED), SIGMAS)


@query(
    "A41_ces_counterfactual",
    "select * from ces",
    "pre_value:2 share_pre share_post tariff_change sigma:2 share_counterfactual share_change log_price_index_change price_index_change",
)
def _(v):
    return ces_view(v)


CES_SUMMARY = """
with w as (select hs10, sigma, sum(pre_value) as w, max(log_price_index_change) as p from ces group by 1, 2),
p as (select sigma, sum(p * w) / sum(w) as aggregate_log_price_index_change from w group by 1),
m as (select c.sigma, sum(share_pre * w) / sum(w) as treated_share_pre, sum(share_counterfactual * w) / sum(w) as treated_share_counterfactual, sum(share_post * w) / sum(w) as treated_share_observed
      from ces c join w on c.hs10 = w.hs10 and c.sigma = w.sigma where country_code = '3' group by 1)
select sigma, aggregate_log_price_index_change, treated_share_pre, treated_share_counterfactual, treated_share_observed from p join m using (sigma)
"""


@query(
    "A41_ces_summary",
    CES_SUMMARY,
    "sigma:2 aggregate_log_price_index_change treated_share_pre treated_share_counterfactual treated_share_observed",
)
def _(v):
    return TD.ces_summary(ces_view(v), TREATED)


@query(
    "A41_best_sigma",
    f"""
with s as ({CES_SUMMARY}), d as (select sigma, abs(treated_share_counterfactual - treated_share_observed) as miss from s)
select (select sigma from d order by round(miss, 12), sigma limit 1) as sigma, min(miss) as miss from d
""",
    "sigma:2 miss",
)
def _(v):
    return TD.best_sigma(TD.ces_summary(ces_view(v), TREATED))


