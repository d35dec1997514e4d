"""Queries for filters, samples, set operations, sorts and top-k."""

from pyspark.sql import functions as F

from quaymetrics.core import hash32
from quaymetrics.operators import loans as LN
from quaymetrics.operators import sampling as S
from quaymetrics.operators import sets as ST
from quaymetrics.registry import query

H = "('0x' || substr(md5({0}), 1, 8))::bigint"


@query(
    "F01_truncate_after_exit",
    """
with ends as (select loan_seq_no, coalesce(min(case when zero_balance_code is not null then period end), max(period)) as observation_end
              from loan_months group by loan_seq_no)
select m.loan_seq_no, m.period, m.current_upb, e.observation_end
from loan_months m join ends e on m.loan_seq_no = e.loan_seq_no where m.period <= e.observation_end
""",
)
def _(v):
    months = v.loan_months
    exit_month = F.min(F.when(F.col("zero_balance_code").isNotNull(), F.col("period")))
    ends = months.groupBy("loan_seq_no").agg(
        F.coalesce(exit_month, F.max("period")).alias("observation_end")
    )
    return S.truncate_after_exit(months, ends, "loan_seq_no", "period").select(
        "loan_seq_no", "period", "current_upb", "observation_end"
    )


@query(
    "F02_restrict",
    """
select hs10, country_code, month_date, unit_qy1 from trade
where unit_qy1 in ('KG', 'NO') and hs6 in (select hs6 from trade group by hs6 having count(distinct unit_qy1) = 1)
""",
)
def _(v):
    trade = v.trade
    stable = trade.groupBy("hs6").agg(F.count_distinct("unit_qy1").alias("n")).where("n = 1")
    out = S.restrict(S.restrict(trade, "unit_qy1", ["KG", "NO"]), "hs6", stable)
    return out.select("hs10", "country_code", "month_date", "unit_qy1")


@query(
    "F03_sample_entities",
    f"select * from loan_months where {H.format('cast(loan_seq_no as varchar)')} % 1000000 < 300000",
    "current_upb:2",
)
def _(v):
    return S.sample_entities(v.loan_months, "loan_seq_no", 0.3)


@query(
    "F04_case_cohort",
    f"""
select *, case when ever_event then 1.0::double else 4.0::double end as sampling_weight from (
  select m.*, max(coalesce(zero_balance_code in ('01', '03'), false)) over (partition by loan_seq_no) as ever_event from loan_months m) s
where ever_event or {H.format("cast(loan_seq_no as varchar) || 'cc'")} % 1000000 < 250000
""",
    "current_upb:2",
)
def _(v):
    event = F.col("zero_balance_code").isin("01", "03")
    return S.case_cohort(v.loan_months, "loan_seq_no", event, 0.25, "cc")


@query(
    "F05_quota_sample",
    f"""
with s as (select *, cast(pickup_datetime as date) as d, hour(pickup_datetime) as h from event_trips),
q as (select d, h, row_number() over (order by d, h) - 1 as i, count(*) over () as c from (select distinct d, h from s) x),
r as (select s.*, row_number() over (partition by d, h order by {H.format('trip_id')}, trip_id) as rk from s)
select r.trip_id, r.d, r.h from r join q on r.d = q.d and r.h = q.h
where rk <= 3000 // c + case when i < 3000 % c then 1 else 0 end
""",
)
def _(v):
    t = v.event_trips.select(
        "trip_id",
        F.to_date("pickup_datetime").alias("d"),
        F.hour("pickup_datetime").alias("h"),
    )
    return S.quota_sample(t, ["d", "h"], 3000, hash32("trip_id"), ["trip_id"])


@query(
    "F06_min_support",
    """
with keep as (select geography from stock group by geography having quantile_cont(n_active_loans, 0.5) >= 3)
select geography, period, n_active_loans from stock where geography in (select geography from keep)
""",
)
def _(v):
    return S.min_support(LN.stock_view(v), "geography", "n_active_loans", 3).select(
        "geography", "period", "n_active_loans"
    )


@query(
    "F07_complete_periods",
    """
select o_orderpriority, year(m) as year, sum(v) as total, count(*) as n_months from (
  select o_orderpriority, date_trunc('month', o_orderdate) as m, sum(o_totalprice) as v from orders group by 1, 2) s
group by o_orderpriority, year(m) having count(*) = 12
""",
    "total:2",
)
def _(v):
    monthly = v.orders.groupBy(
        "o_orderpriority", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")
    ).agg(F.sum("o_totalprice").alias("v"))
    return S.complete_periods(monthly, ["o_orderpriority"], "m", F.col("v"), "total")


@query(
    "F08_complete_cases",
    """
select loan_seq_no, credit_score, log_gap from (
  select loan_seq_no, credit_score, case when loan_seq_no % 7 > 0 then ln(loan_seq_no % 7) else cast('-inf' as double) end as log_gap
  from originations) s
where credit_score is not null and isfinite(log_gap)
""",
    "log_gap",
)
def _(v):
    k = F.col("loan_seq_no") % 7
    df = v.originations.select(
        "loan_seq_no",
        "credit_score",
        F.when(k > 0, F.ln(k)).otherwise(F.lit(float("-inf"))).alias("log_gap"),
    )
    return S.complete_cases(df, ["credit_score", "log_gap"])


@query(
    "F09_period_blocks",
    """
select series_id, period, model_id, case when r <= 12 then 'final_evaluation' when r <= 36 then 'tuning_validation'
       else 'model_development' end as evaluation_block
from (select *, dense_rank() over (order by period desc) as r from forecasts) s
""",
)
def _(v):
    return S.period_blocks(v.forecasts, "period", 24, 12).select(
        "series_id", "period", "model_id", "evaluation_block"
    )


@query(
    "F10_select_concept",
    """
select o_orderpriority as geography, 'place ' || o_orderpriority as place_name,
       make_date(year(o_orderdate)::integer, ((quarter(o_orderdate) - 1) * 3 + 1)::integer, 1) as period, avg(o_totalprice) as hpi,
       'nsa (sa unavailable for this concept)' as index_basis, 'purchase-only' as hpi_flavor,
       'quarterly' as hpi_frequency, 'State' as hpi_level
from orders group by o_orderpriority, year(o_orderdate), quarter(o_orderdate)
""",
    "hpi:3",
)
def _(v):
    return S.select_concept(hpi_long(v), "purchase-only", "quarterly", "State", "sa")


def hpi_long(v):
    """A long multi-concept index file: monthly all-transactions, quarterly purchase-only."""
    place = F.col("o_orderpriority")

    def concept(frequency, period, flavor, adjusted):
        return (
            v.orders.groupBy(place.alias("place_id"), F.year("o_orderdate").alias("yr"), period.alias("period"))
            .agg(F.avg("o_totalprice").alias("index_nsa"))
            .select(
                "place_id",
                F.concat(F.lit("place "), F.col("place_id")).alias("place_name"),
                "yr",
                "period",
                "index_nsa",
                (F.col("index_nsa") if adjusted else F.lit(None).cast("double")).alias("index_sa"),
                F.lit(flavor).alias("hpi_flavor"),
                F.lit(frequency).alias("frequency"),
                F.lit("State").alias("level"),
            )
        )

    return concept(
        "quarterly", F.quarter("o_orderdate"), "purchase-only", False
    ).unionByName(concept("monthly", F.month("o_orderdate"), "all-transactions", True))


# --- sorts and top-k --------------------------------------------------------------


@query(
    "K01_total_order",
    """
select hs10, country_code, month_date, con_val_mo,
       row_number() over (order by month_date, con_val_mo desc, hs10, country_code) as position from trade
""",
)
def _(v):
    return ST.total_order(
        v.trade.select("hs10", "country_code", "month_date", "con_val_mo"),
        ["month_date", F.desc("con_val_mo"), "hs10", "country_code"],
        "position",
    )


@query(
    "K02_top_k",
    """
with f as (select series_id, observation_date, arg_min(coalesce(value, -1), realtime_start) as a,
                  arg_max(coalesce(value, -1), realtime_start) as b from vintages group by 1, 2)
select series_id, observation_date, abs(b - a) as absolute_revision from f where a >= 0 and b >= 0
order by absolute_revision desc, series_id, observation_date limit 10
""",
    "absolute_revision:2",
)
def _(v):
    from quaymetrics.operators.vintage import revision_details

    details = revision_details(v.vintages).where(F.col("absolute_revision").isNotNull())
    return ST.top_k(
        details, 10, [F.desc("absolute_revision"), "series_id", "observation_date"]
    ).select("series_id", "observation_date", "absolute_revision")


@query(
    "K03_best_per_group",
    """
select series_id, model_id, rmse from (
  select *, row_number() over (partition by series_id order by rmse, model_id) as rn from (
    select series_id, model_id, sqrt(avg((actual - prediction) * (actual - prediction))) as rmse from forecasts group by 1, 2) m) r
where rn = 1
""",
    "rmse:2",
)
def _(v):
    err = F.col("actual") - F.col("prediction")
    metrics = v.forecasts.groupBy("series_id", "model_id").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    return ST.best_per_group(metrics, ["series_id"], ["rmse", "model_id"])


# --- set operations ---------------------------------------------------------------


@query(
    "U03_diagonal_concat",
    """
select hs10, country_code, con_val_mo, cast(null as varchar) as unit_qy1 from trade
union all select hs10, null, null, unit_qy1 from trade
""",
)
def _(v):
    t = v.trade
    return ST.diagonal_concat(
        t.select("hs10", "country_code", "con_val_mo"), t.select("hs10", "unit_qy1")
    )


@query(
    "U04_dedup",
    """
select l_orderkey, l_partkey, l_suppkey, l_extendedprice from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as rn
  from lineitem) s where rn = 1
""",
)
def _(v):
    rows = v.lineitem.select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    out = ST.dedup(
        rows,
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"],
    )
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "A20_pivot_measures",
    "select o_custkey % 100 as area, year(o_orderdate) as year, "
    + ", ".join(
        f"sum(case when o_orderstatus = '{s}' then o_totalprice end) as {s}_sum, "
        f"count(case when o_orderstatus = '{s}' then o_totalprice end) as {s}_count"
        for s in ("F", "O", "P")
    )
    + " from orders group by 1, 2",
    "F_sum:2 O_sum:2 P_sum:2",
)
def _(v):
    long = v.orders.select(
        (F.col("o_custkey") % 100).alias("area"),
        F.year("o_orderdate").alias("year"),
        "o_orderstatus",
        "o_totalprice",
    )
    return ST.pivot_measures(
        long, ["area", "year"], "o_orderstatus", ["F", "O", "P"], "o_totalprice"
    )
