"""Queries for lookups, prefix matches, crosswalks and panel assembly."""

from pyspark.sql import functions as F

from quaymetrics.operators import joins as J
from quaymetrics.operators import loans as LN
from quaymetrics.operators import windows as W
from quaymetrics.plans.selections import hpi_long
from quaymetrics.operators import sampling as S
from quaymetrics.registry import cte, query


@query(
    "J01_inner_join",
    """
select o_orderstatus, l_returnflag, count(*) as n, sum(l_extendedprice) as total from lineitem join orders on l_orderkey = o_orderkey group by 1, 2
""",
    "total:1",
)
def _(v):
    lines = v.lineitem.select(
        F.col("l_orderkey").alias("orderkey"), "l_returnflag", "l_extendedprice"
    )
    orders = v.orders.select(F.col("o_orderkey").alias("orderkey"), "o_orderstatus")
    return (
        J.inner_join(lines, orders, ["orderkey"])
        .groupBy("o_orderstatus", "l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total"))
    )


def adapters(v):
    # a fourth of the customers is filed under another numbering
    k = F.col("c_custkey")
    customers = v.customer.select(
        F.when(k % 4 == 0, -k).otherwise(k).alias("o_custkey"), "c_mktsegment", "c_acctbal"
    )
    return [
        J.Enrichment("customer", customers, ["o_custkey"], required=True),
        J.Enrichment("weather", None, ["o_orderdate"]),
    ]


@query(
    "J02_enrich",
    """
select o_orderkey, o_custkey, c_mktsegment as customer__c_mktsegment, c_acctbal as customer__c_acctbal
from orders left join (select * replace (case when c_custkey % 4 = 0 then -c_custkey else c_custkey end as c_custkey) from customer) c on o_custkey = c_custkey
""",
)
def _(v):
    out, _ = J.enrich(v.orders.select("o_orderkey", "o_custkey"), adapters(v))
    return out


@query(
    "J02_coverage",
    """
select 'customer' as name, 'joined' as status, count(*) filter (where o_custkey in (select case when c_custkey % 4 = 0 then -c_custkey else c_custkey end from customer)) as matched_rows, count(*) as total_rows,
       count(*) filter (where o_custkey in (select case when c_custkey % 4 = 0 then -c_custkey else c_custkey end from customer)) / count(*)::double as coverage_rate from orders
union all select 'weather', 'unavailable_optional', 0, count(*), null from orders
""",
    "coverage_rate",
)
def _(v):
    _, coverage = J.enrich(v.orders.select("o_orderkey", "o_custkey"), adapters(v))
    return coverage


@query("J03_asof_rate", "select period, market_rate, rate_obs_date from monthly_rates", "market_rate")
def _(v):
    return LN.monthly_rate(v.weekly_rates, "pmms30").drop("rate_available_from")


@query(
    "J03_asof_by_key",
    """
select p.zone, p.day, r.total from (select distinct c_nationkey % 5 as zone, cast(o_orderdate as date) as day from orders join customer on o_custkey = c_custkey) p
asof left join (select s_nationkey % 5 as zone, cast(date_trunc('week', l_shipdate) as date) as day, sum(l_extendedprice) as total from lineitem join supplier on l_suppkey = s_suppkey
  group by 1, 2) r on p.zone = r.zone and p.day >= r.day
""",
    "total:2",
)
def _(v):
    from quaymetrics.core import asof_backward

    left = (
        v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select((F.col("c_nationkey") % 5).alias("zone"), F.to_date("o_orderdate").alias("day"))
        .distinct()
    )
    right = (
        v.lineitem.join(v.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            (F.col("s_nationkey") % 5).alias("zone"),
            F.to_date(F.date_trunc("week", "l_shipdate")).alias("ship_day"),
        )
        .agg(F.sum("l_extendedprice").alias("total"))
    )
    return asof_backward(left, right, "day", "ship_day", ["total"], ["zone"])


@query(
    "J04_attach_rate",
    "select m.loan_seq_no, m.period, r.market_rate, r.rate_obs_date from loan_months m left join monthly_rates r on m.period = r.period",
    "market_rate",
)
def _(v):
    rates = LN.monthly_rate(v.weekly_rates, "pmms30")
    out = LN.attach_rate(v.loan_months, rates)
    return out.select("loan_seq_no", "period", "market_rate", "rate_obs_date")


@query(
    "J09_skeleton",
    """
with s as (select distinct o_custkey as k, year(o_orderdate) as year from orders),
k as (select o_custkey as k from orders union select c_custkey from customer)
select k.k as entity, cast(y as integer) as year, s.k is not null as has_data from k, range(1995, 2002) t(y) left join s on s.k = k.k and s.year = y
""",
)
def _(v):
    seen = v.orders.select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")
    )
    every = v.customer.select(F.col("c_custkey").alias("entity"))
    return J.skeleton([seen, every], "entity", 1995, 2001, seen.distinct())


cte(
    "claims",
    """
select n_name as target, '00' || lpad(cast(n_nationkey % 20 as varchar), 2, '0') as prefix from nation
union all select n_name, '00' || lpad(cast(n_nationkey as varchar), 2, '0') || cast(d as varchar) from nation, range(1, 4) t(d) where n_nationkey between 4 and 9
union all select n_name, '001' from nation where n_nationkey = 11
""",
)


@query(
    "J12_prefix_map",
    """
with c as (select distinct lpad(cast(p_partkey as varchar), 6, '0') as code from part),
h as (select code, length(prefix) as depth, count(distinct target) as n, min(target) as t from c join claims on starts_with(code, prefix) group by 1, 2),
b as (select *, row_number() over (partition by code order by depth desc) as rn from h)
select c.code, case when n = 1 then t end as target, depth as match_depth, case when depth is null then 'unmapped' when n > 1 then 'ambiguous' else 'mapped' end as match_status
from c left join b on c.code = b.code and rn = 1
""",
)
def _(v):
    k = F.col("n_nationkey")
    two = F.lpad((k % 20).cast("string"), 2, "0")
    own = F.lpad(k.cast("string"), 2, "0")
    run = F.when(k.between(4, 9), F.concat(F.lit("; 00"), own, F.lit("1-3 "))).otherwise("")
    wide = F.when(k == 11, ", 001*").otherwise(", n.a.")
    listed = v.nation.select(
        F.col("n_name").alias("target"), F.concat(F.lit("00"), two, run, wide).alias("related")
    )
    codes = v.part.select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"))
    return J.prefix_map(codes, "code", J.expand_tokens(listed, "related"), "target")


# Links of product codes: one splits, two merge, one is renumbered, the rest are unchanged.
cte(
    "links",
    """
with k as (select distinct hs6, cast(hs6 as integer) as i from trade)
select hs6 as from_code, hs6 as to_code, '2012' as from_vintage, '2017' as to_vintage, 1.0::double as weight from k where i not in (1, 2, 3, 4, 5)
union all select hs6, hs6, '2012', '2017', 0.6 from k where i = 1 union all select hs6, '900001', '2012', '2017', 0.4 from k where i = 1
union all select hs6, '900023', '2012', '2017', 1.0 from k where i in (2, 3)
union all select hs6, '900004', '2012', '2017', 1.0 from k where i = 4
""",
)


def links(v):
    codes = v.trade.select("hs6").distinct().withColumn("i", F.col("hs6").try_cast("int"))
    i = F.col("i")

    def to(code, weight):
        return F.struct(code.alias("to_code"), F.lit(weight).alias("weight"))

    targets = (
        F.when(i == 1, F.array(to(F.col("hs6"), 0.6), to(F.lit("900001"), 0.4)))
        .when(i.isin(2, 3), F.array(to(F.lit("900023"), 1.0)))
        .when(i == 4, F.array(to(F.lit("900004"), 1.0)))
        .when(i != 5, F.array(to(F.col("hs6"), 1.0)))
    )
    return codes.select(
        F.col("hs6").alias("from_code"),
        F.lit("2012").alias("from_vintage"),
        F.lit("2017").alias("to_vintage"),
        F.explode(targets).alias("t"),
    ).select("from_code", "t.to_code", "from_vintage", "to_vintage", "t.weight")


cte(
    "classified",
    """
select *, case when o > 1 and i > 1 then 'MANY_TO_MANY' when o > 1 then 'ONE_TO_MANY' when i > 1 then 'MANY_TO_ONE' else 'ONE_TO_ONE' end as mapping_type
from (select *, count(*) over (partition by from_code) as o, count(*) over (partition by to_code) as i from links) x
""",
)


@query(
    "A38_classify_links",
    "select from_code, to_code, from_vintage, to_vintage, weight, mapping_type from classified",
    "weight",
)
def _(v):
    return J.classify_links(links(v))


@query(
    "A38_link_report",
    "select mapping_type, count(*) as n_links, count(*) filter (where mapping_type = 'ONE_TO_ONE' and from_code = to_code and weight = 1) as n_stable_codes from classified group by 1",
)
def _(v):
    return J.link_report(J.classify_links(links(v)))


@query(
    "J13_apply_concordance",
    """
select coalesce(c.to_code, t.hs6) as hs6, country_code, month_date, hs10, con_val_mo * coalesce(weight, 1) as con_val_mo, con_qy1_mo * coalesce(weight, 1) as con_qy1_mo,
       coalesce(weight, 1) as concordance_weight, coalesce(mapping_type, 'UNRESOLVED') as concordance_mapping_type
from trade t left join classified c on t.hs6 = c.from_code
""",
    "con_val_mo:3 con_qy1_mo:2 concordance_weight",
)
def _(v):
    flows = v.trade.select(
        "hs6", "country_code", "month_date", "hs10", "con_val_mo", "con_qy1_mo"
    )
    return J.apply_concordance(
        flows, J.classify_links(links(v)), "hs6", ["con_val_mo", "con_qy1_mo"]
    )


@query(
    "J14_split_mapped",
    """
with d as (select distinct hs6 from trade), m as (select distinct lpad(cast(p_partkey % 30 + case when p_partkey % 30 in (4, 9) then 900 else 0 end as varchar), 6, '0') as hs6 from part)
select hs6, 'mapped' as kind from d where hs6 in (select hs6 from m) union all select hs6, 'unmapped' from d where hs6 not in (select hs6 from m)
union all select hs6, 'orphan' from m where hs6 not in (select hs6 from d)
""",
)
def _(v):
    key = F.col("p_partkey") % 30
    code = key + F.when(key.isin(4, 9), 900).otherwise(0)
    mapping = v.part.select(F.lpad(code.cast("string"), 6, "0").alias("hs6"))
    return J.split_mapped(v.trade, mapping, "hs6")


@query(
    "J16_check_keys",
    """
with a as (select distinct o_custkey as k from orders), b as (select case when c_custkey % 3 = 0 then -c_custkey else c_custkey end as k from customer)
select (select count(*) from a) as left_keys, (select count(*) from b) as right_keys, (select count(*) from a join b using (k)) as shared_keys, 'partial' as verdict
""",
)
def _(v):
    a = v.orders.select(F.col("o_custkey").alias("k"))
    b = v.customer.select(F.expr("if(c_custkey % 3 = 0, -c_custkey, c_custkey)").alias("k"))
    return J.check_keys(a, b, "k")


# Permits and unemployment of an area, from customers and suppliers; some months are absent.
cte(
    "permits",
    "select cast(c_nationkey as varchar) as geography, cast(date_trunc('month', o_orderdate) as date) as period, count(*) as permits from orders join customer on o_custkey = c_custkey group by 1, 2",
)
cte(
    "unemployment",
    """
select cast(s_nationkey as varchar) as geography, cast(date_trunc('month', l_shipdate) as date) as period, round(3 + 100 * avg(l_discount), 4) as unemployment_rate
from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2
""",
)


def permits(v):
    return (
        v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_nationkey").cast("string").alias("geography"),
            F.trunc(F.to_date("o_orderdate"), "month").alias("period"),
        )
        .agg(F.count(F.lit(1)).alias("permits"))
    )


def unemployment(v):
    return (
        v.lineitem.join(v.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.col("s_nationkey").cast("string").alias("geography"),
            F.trunc(F.to_date("l_shipdate"), "month").alias("period"),
        )
        .agg(F.round(3 + 100 * F.avg("l_discount"), 4).alias("unemployment_rate"))
    )


@query(
    "J17_monthly_panel",
    """
select s.geography, s.period, s.n_active_loans, h.hpi, h.g as hpi_growth_12m, p.permits, u.unemployment_rate
from stock s left join (select *, ln(hpi) - lag(ln(hpi), 12) over (partition by geography order by period) as g from state_index) h on s.geography = h.geography and s.period = h.period
left join permits p on s.geography = p.geography and s.period = p.period left join unemployment u on s.geography = u.geography and s.period = u.period
""",
    "hpi:3 hpi_growth_12m unemployment_rate:4",
)
def _(v):
    out = J.monthly_panel(LN.stock_view(v), LN.index_view(v), permits(v), unemployment(v))
    return out.select(
        "geography",
        "period",
        "n_active_loans",
        "hpi",
        "hpi_growth_12m",
        "permits",
        "unemployment_rate",
    )


cte(
    "local_panel",
    """
with k as (select geography from stock union select geography from state_index),
s as (select geography, year(period) as year, avg(n_active_loans) as mean_active_loans, avg(wavg_note_rate_upb) as wavg_note_rate_upb, cast(sum(n_prepayments) as bigint) as n_prepayments from stock group by 1, 2),
hg as (select *, ln(hpi) - lag(ln(hpi), 12) over (partition by geography order by period) as g from state_index),
h as (select geography, year(period) as year, arg_min(hpi, period) as a, arg_max(hpi, period) as b, nullif(arg_max(coalesce(g, -99), period), -99) as g from hg group by 1, 2),
p as (select geography, year(period) as year, cast(sum(permits) as bigint) as permits from permits group by 1, 2 having count(*) = 12),
u as (select geography, year(period) as year, avg(unemployment_rate) as ur from unemployment group by 1, 2 having count(*) = 12)
select k.geography, cast(y as integer) as year, s.geography is not null as has_stock_data, mean_active_loans, wavg_note_rate_upb, n_prepayments, h.a as hpi_year_start, h.b as hpi_year_end,
       h.g as hpi_growth_12m_dec, permits, ur as unemployment_rate, ln(permits) as log_permits, ln(h.b) as log_hpi
from k cross join range(1995, 2002) t(y) left join s on s.geography = k.geography and s.year = y left join h on h.geography = k.geography and h.year = y
left join p on p.geography = k.geography and p.year = y left join u on u.geography = k.geography and u.year = y
""",
)


@query(
    "J17_local_panel",
    "select * from local_panel",
    "mean_active_loans wavg_note_rate_upb hpi_year_start:3 hpi_year_end:3 hpi_growth_12m_dec unemployment_rate log_permits log_hpi",
)
def _(v):
    return J.local_panel(
        LN.stock_view(v), LN.index_view(v), permits(v), unemployment(v), 1995, 2001
    )


cte(
    "applications",
    """
select cast(c_nationkey as varchar) as geography, year(o_orderdate) as year, count(*) filter (where b and m) as n_purchase_originations, count(*) filter (where not b and m) as n_refi_originations,
       count(*) filter (where b) as n_purchase_applications, count(*) filter (where b and not m) as n_purchase_denials
from (select *, o_orderpriority in ('1-URGENT', '2-HIGH') as b, o_orderkey % 5 > 0 as m from orders) o join customer on o_custkey = c_custkey group by 1, 2
""",
)


def applications(v):
    rows = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("string").alias("geography"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "purchase").otherwise("refinance").alias("purpose"),
        F.when(F.col("o_orderkey") % 5 > 0, "originated").otherwise("denied").alias("action"),
    )
    return J.application_counts(rows)


@query(
    "J17_market_outcomes",
    """
with e as (select geography, n_active_loans as pre_n_active_loans, wavg_note_rate_upb as pre_wavg_note_rate_upb from stock where period = date '1996-12-01'),
g as (select geography, ln(arg_max(hpi, period)) - ln(arg_min(hpi, period)) as pre_hpi_growth from state_index where period between date '1995-01-01' and date '1997-12-01' group by 1),
r as (select geography, cast(sum(n_refi_originations) as bigint) as pre_refi_count from applications where year between 1996 and 1997 group by 1),
f as (select cast(s_nationkey as varchar) as geography, avg(cast(s_acctbal > 0 as double)) as remote_share from supplier group by 1)
select p.geography, p.year, n_purchase_originations, n_refi_originations, n_purchase_applications, n_purchase_denials, case when n_purchase_originations > 0 then ln(n_purchase_originations) end as log_purchase_originations,
       case when n_refi_originations > 0 then ln(n_refi_originations) end as log_refi_originations, n_purchase_denials / nullif(n_purchase_applications, 0)::double as denial_rate, pre_refi_count,
       ln(hpi_year_end) - ln(hpi_year_start) as hpi_growth, pre_n_active_loans, pre_wavg_note_rate_upb, pre_hpi_growth, remote_share
from local_panel p left join applications a on a.geography = p.geography and a.year = p.year left join e on e.geography = p.geography left join g on g.geography = p.geography
left join r on r.geography = p.geography left join f on f.geography = p.geography
""",
    "log_purchase_originations log_refi_originations denial_rate hpi_growth pre_wavg_note_rate_upb pre_hpi_growth remote_share",
)
def _(v):
    stock, index = LN.stock_view(v), LN.index_view(v)
    panel = J.local_panel(stock, index, permits(v), unemployment(v), 1995, 2001)
    frozen = stock.where(F.col("period") == F.lit("1996-12-01").cast("date")).select(
        "geography", "n_active_loans", "wavg_note_rate_upb"
    )
    remote = v.supplier.groupBy(F.col("s_nationkey").cast("string").alias("geography")).agg(
        F.avg((F.col("s_acctbal") > 0).cast("double")).alias("remote_share")
    )
    out = J.market_outcomes(
        panel, applications(v), frozen, index, remote, ("1995-01-01", "1997-12-01"), (1996, 1997)
    )
    return out.drop(*[c for c in panel.columns if c not in ("geography", "year")])


cte(
    "delineation",
    "select case when n_nationkey = 12 then 'old-' else '' end || cast(n_nationkey as varchar) as child, r_name as parent, 'v2013' as vintage from nation join region on n_regionkey = r_regionkey union all select cast(n_nationkey as varchar), r_name, 'v2018' from nation join region on (n_nationkey + 1) % 5 = r_regionkey",
)


def delineation(v):
    n, r = v.nation, v.region
    k = F.col("n_nationkey").cast("string")
    first = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn(
        "child", F.when(F.col("n_nationkey") == 12, F.concat(F.lit("old-"), k)).otherwise(k)
    )
    second = n.join(r, (F.col("n_nationkey") + 1) % 5 == F.col("r_regionkey")).withColumn("child", k)

    def rows(df, vintage):
        return df.select(
            "child",
            F.col("r_name").alias("parent"),
            F.lit(vintage).alias("vintage"),
        )

    return rows(first, "v2013").unionByName(rows(second, "v2018"))


@query(
    "J18_to_parent",
    "select loan_seq_no, property_state, parent as parent_area from originations left join delineation on property_state = child and vintage = 'v2013'",
)
def _(v):
    loans = v.originations.select("loan_seq_no", "property_state")
    return J.to_parent(loans, "property_state", delineation(v), "v2013")


@query(
    "J19_merge_strict",
    """
select series_id, observation_date, min(r) as first_release, count(*) as n_sources from (
  select series_id, observation_date, min(realtime_start) as r from vintages group by 1, 2
  union all select o_orderpriority, cast(date_trunc('month', o_orderdate) as date), min(cast(l_shipdate as date)) from lineitem join orders on l_orderkey = o_orderkey
    group by 1, 2) m group by 1, 2
""",
)
def _(v):
    a = v.vintages.groupBy("series_id", "observation_date").agg(
        F.min("realtime_start").alias("first_release")
    )
    b = (
        v.lineitem.join(v.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.trunc(F.to_date("o_orderdate"), "month").alias("observation_date"),
        )
        .agg(F.min(F.to_date("l_shipdate")).alias("first_release"))
    )
    return J.merge_strict([a, b], ["series_id", "observation_date"], "first_release")


# --- code vintages ----------------------------------------------------------------


@query(
    "A37_code_stability",
    """
with m as (select distinct year(o_orderdate) as vintage, case when year(o_orderdate) = 2001 and c_mktsegment = 'MACHINERY' then 'MACHINES' else c_mktsegment end as code,
             case when year(o_orderdate) = 1999 and c_mktsegment = 'HOUSEHOLD' and o_orderstatus = 'P' then 'R' else o_orderstatus end
             || cast(case when year(o_orderdate) = 1997 and c_mktsegment = 'BUILDING' and c_nationkey % 3 = 1 then 0 else c_nationkey % 3 end as varchar) as member
           from orders join customer on o_custkey = c_custkey),
s as (select code, vintage, string_agg(member, '|' order by member) as members, count(*) as n from m group by 1, 2)
select code, count(*) as vintages_present, count(distinct members) as distinct_sets,
       case when count(*) < (select count(distinct vintage) from m) then 'not_in_all_vintages' when count(distinct members) = 1 then 'stable'
            when min(n) = max(n) then 'composition_changed' else 'membership_count_changed' end as verdict
from s group by code
""",
)
def _(v):
    seg, y = F.col("c_mktsegment"), F.year("o_orderdate")
    n3 = F.col("c_nationkey") % 3
    status = F.col("o_orderstatus")
    code = F.when((y == 2001) & (seg == "MACHINERY"), "MACHINES").otherwise(seg)
    new = F.when((y == 1999) & (seg == "HOUSEHOLD") & (status == "P"), "R").otherwise(status)
    third = F.when((y == 1997) & (seg == "BUILDING") & (n3 == 1), 0).otherwise(n3)
    members = (
        v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            y.alias("vintage"),
            code.alias("code"),
            F.concat(new, third.cast("string")).alias("member"),
        )
    )
    return J.code_stability(members)


cte(
    "code_vintages",
    """
select case when p_partkey % 5 = 0 and y = 2017 or p_partkey % 7 = 0 and y = 2020 then 'x' else '' end || cast(p_partkey as varchar) as code, cast(y as integer) as year,
       case when y < 2019 then 'A' || cast(p_size % 9 as varchar) else case when p_size % 9 = 4 then 'B4' else 'A' || cast((p_size + p_partkey % 11 // 10) % 9 as varchar) end end as target
from part, range(2017, 2021) t(y)
""",
)


def code_vintages(v):
    p, size = F.col("p_partkey"), F.col("p_size")
    new = F.when(size % 9 == 4, "B4").otherwise(
        F.concat(F.lit("A"), ((size + F.floor(p % 11 / 10)) % 9).cast("string"))
    )
    old = F.concat(F.lit("A"), (size % 9).cast("string"))
    other = ((p % 5 == 0) & (F.col("year") == 2017)) | ((p % 7 == 0) & (F.col("year") == 2020))
    return (
        v.part.withColumn("year", F.explode(F.sequence(F.lit(2017), F.lit(2020))))
        .select(
            F.concat(F.when(other, "x").otherwise(""), p.cast("string")).alias("code"),
            "year",
            F.when(F.col("year") < 2019, old).otherwise(new).alias("target"),
        )
    )


@query(
    "A39_stack_mappings",
    """
with c as (select code, target, year from (select *, row_number() over (partition by code order by year <> 2017, year) as rn from code_vintages) x where rn = 1),
n as (select * from code_vintages where year = 2020), pr as (select * from code_vintages where year = 2017),
mv as (select distinct v.code from code_vintages v join pr on v.code = pr.code where v.year <> 2017 and v.target <> pr.target)
select c.code, case when c.target not in (select target from n) and n.target is not null then n.target else c.target end as target, c.year as vintage_year, c.year = 2017 as from_primary,
       c.target not in (select target from n) and n.target is not null as repaired, mv.code is not null as reclassified
from c left join n on c.code = n.code left join mv on c.code = mv.code
""",
)
def _(v):
    return J.stack_mappings(code_vintages(v), 2017)


# --- windows on an index ----------------------------------------------------------

cte(
    "quarterly_index",
    """
select o_orderpriority as geography, make_date(year(o_orderdate)::integer, ((quarter(o_orderdate) - 1) * 3 + 1)::integer, 1) as period, avg(o_totalprice) as hpi
from orders group by 1, 2
""",
)


@query(
    "W01_growth",
    """
select geography, period, hpi, ln(hpi) - lag(ln(hpi), 1) over w as hpi_logdiff_1, ln(hpi) - lag(ln(hpi), 4) over w as hpi_logdiff_4
from quarterly_index window w as (partition by geography order by period)
""",
    "hpi:3 hpi_logdiff_1 hpi_logdiff_4",
)
def _(v):
    index = S.select_concept(hpi_long(v), "purchase-only", "quarterly", "State")
    return W.growth(index.select("geography", "period", "hpi"), ["geography"], "period", "hpi", (1, 4))


@query(
    "W02_to_monthly",
    """
select geography, cast(period + k * interval 1 month as date) as period, hpi, 'nsa+held-constant-within-quarter' as index_basis, 'quarterly-expanded-to-monthly' as hpi_frequency
from quarterly_index, range(0, 3) t(k)
""",
    "hpi:3",
)
def _(v):
    index = S.select_concept(hpi_long(v), "purchase-only", "quarterly", "State")
    return W.to_monthly(index).select("geography", "period", "hpi", "index_basis", "hpi_frequency")


