"""Queries for scalar functions and row-wise measures."""

from datetime import date

from pyspark.sql import functions as F

from quaymetrics.core import ordered
from quaymetrics.functions import columns as C
from quaymetrics.functions import lending as L
from quaymetrics.operators import trips as TR
from quaymetrics.operators import vintage as VT
from quaymetrics.registry import cte, query

# --- trips ------------------------------------------------------------------------

cte(
    "raw_b",
    """
select event_id, ' HV' || cast(user_id % 4 as varchar) || ' ' as hvfhs_license_num,
       case when user_id % 9 = 0 then '' else 'B' || cast(user_id % 9 as varchar) end as dispatching_base_num,
       ts - interval 4 minute as request_datetime, ts as pickup_datetime, ts + interval 11 minute as dropoff_datetime,
       user_id % 263 + 1 as PULocationID, case when event_id % 10 = 0 then null else (user_id * 7 + event_id) % 263 + 1 end as DOLocationID,
       value / 4 as trip_miles, 660 as trip_time, case when event_id % 13 = 0 then null else value end as base_passenger_fare,
       case when event_id % 5 = 0 then null else 1.25::double end as tolls, 0.5::double as bcf, 0.75::double as sales_tax,
       case when event_id % 3 = 0 then null else 2.75::double end as congestion_surcharge,
       case when event_id % 17 = 0 then 2.5::double else null end as airport_fee, 1.5::double as tips, value / 2 as driver_pay,
       case when event_type = 'purchase' then 'y' when event_type = 'error' then 'x' else ' N ' end as shared_request_flag,
       case when event_type = 'purchase' then 'Y' else 'N' end as shared_match_flag
from events
""",
)


def raw_b(v):
    e = v.events
    eid, uid, val = F.col("event_id"), F.col("user_id"), F.col("value")
    minute = F.expr("interval 1 minute")
    return e.select(
        "event_id",
        F.concat(F.lit(" HV"), (uid % 4).cast("string"), F.lit(" ")).alias("hvfhs_license_num"),
        F.when(uid % 9 == 0, "")
        .otherwise(F.concat(F.lit("B"), (uid % 9).cast("string")))
        .alias("dispatching_base_num"),
        (F.col("ts") - minute * 4).alias("request_datetime"),
        F.col("ts").alias("pickup_datetime"),
        (F.col("ts") + minute * 11).alias("dropoff_datetime"),
        (uid % 263 + 1).alias("PULocationID"),
        F.when(eid % 10 != 0, (uid * 7 + eid) % 263 + 1).alias("DOLocationID"),
        (val / 4).alias("trip_miles"),
        F.lit(660).alias("trip_time"),
        F.when(eid % 13 != 0, val).alias("base_passenger_fare"),
        F.when(eid % 5 != 0, 1.25).alias("tolls"),
        F.lit(0.5).alias("bcf"),
        F.lit(0.75).alias("sales_tax"),
        F.when(eid % 3 != 0, 2.75).alias("congestion_surcharge"),
        F.when(eid % 17 == 0, 2.5).alias("airport_fee"),
        F.lit(1.5).alias("tips"),
        (val / 2).alias("driver_pay"),
        F.when(F.col("event_type") == "purchase", "y")
        .when(F.col("event_type") == "error", "x")
        .otherwise(" N ")
        .alias("shared_request_flag"),
        F.when(F.col("event_type") == "purchase", "Y").otherwise("N").alias("shared_match_flag"),
    )


CLEAN_COLUMNS = (
    "trip_id, provider_id, dispatching_base_id, request_datetime, pickup_datetime, "
    "dropoff_datetime, pickup_datetime_utc, service_date, service_year, service_month, "
    "service_day_of_week, pickup_zone_id, dropoff_zone_id, trip_seconds, trip_miles, fare, tips, "
    "tolls, taxes_and_surcharges, additional_charges, total_amount, driver_pay, airport_fee, "
    "shared_requested, shared_matched, airport_trip, pickup_zone_missing, dropoff_zone_missing, "
    "pickup_on_15_minute_grid"
)

CLEAN_B_SQL = """
select 'nyc_hvfhv' as source, 'nyc_hvfhv:' || trim(hvfhs_license_num) || ':' || strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S.%f') || ':'
         || strftime(dropoff_datetime, '%Y-%m-%d %H:%M:%S.%f') || ':' || cast(PULocationID as varchar) || ':'
         || coalesce(cast(DOLocationID as varchar), 'unknown') || ':' || cast(event_id as varchar) as trip_id,
       trim(hvfhs_license_num) as provider_id, nullif(trim(dispatching_base_num), '') as dispatching_base_id,
       request_datetime, pickup_datetime, dropoff_datetime, pickup_datetime + interval 5 hour as pickup_datetime_utc,
       cast(pickup_datetime as date) as service_date, cast(year(pickup_datetime) as integer) as service_year,
       cast(month(pickup_datetime) as integer) as service_month, cast(isodow(pickup_datetime) as integer) as service_day_of_week,
       cast(PULocationID as varchar) as pickup_zone_id, cast(DOLocationID as varchar) as dropoff_zone_id,
       cast(trip_time as bigint) as trip_seconds, trip_miles, base_passenger_fare as fare, tips, tolls,
       bcf + sales_tax + coalesce(congestion_surcharge, 0) as taxes_and_surcharges,
       bcf + sales_tax + coalesce(congestion_surcharge, 0) + coalesce(tolls, 0) + coalesce(airport_fee, 0) as additional_charges,
       coalesce(base_passenger_fare, 0) + tips + bcf + sales_tax + coalesce(congestion_surcharge, 0)
         + coalesce(tolls, 0) + coalesce(airport_fee, 0) as total_amount,
       driver_pay, airport_fee,
       case upper(trim(shared_request_flag)) when 'Y' then true when 'N' then false end as shared_requested,
       case upper(trim(shared_match_flag)) when 'Y' then true when 'N' then false end as shared_matched,
       coalesce(airport_fee, 0) > 0 or PULocationID in (1, 132, 138) or coalesce(DOLocationID in (1, 132, 138), null) as airport_trip,
       PULocationID is null as pickup_zone_missing, DOLocationID is null as dropoff_zone_missing,
       minute(pickup_datetime) % 15 = 0 and millisecond(pickup_datetime) = 0 as pickup_on_15_minute_grid
from raw_b
"""
FEES = "trip_miles fare tips tolls taxes_and_surcharges additional_charges total_amount driver_pay airport_fee"


def show_clean(df):
    return df.select(*CLEAN_COLUMNS.split(", ")).withColumns(
        {
            "pickup_datetime_utc": F.col("pickup_datetime_utc").cast("timestamp_ntz"),
            "service_month": F.col("service_month").cast("int"),
            "service_day_of_week": F.col("service_day_of_week").cast("int"),
        }
    )


@query("P01_normalize_source_b", f"select {CLEAN_COLUMNS} from ({CLEAN_B_SQL}) b", FEES)
def _(v):
    return show_clean(TR.normalize_source_b(raw_b(v), F.col("event_id")))


CLEAN_A_SQL = """
select 'chicago_tnp' as source, cast(event_id as varchar) as trip_id, date_trunc('minute', ts) as pickup_datetime,
       date_trunc('minute', ts) + interval 6 hour as pickup_datetime_utc,
       cast(ts as date) as service_date, cast(user_id % 77 + 1 as varchar) as pickup_zone_id,
       case when event_id % 10 = 0 then null else cast(event_id % 77 + 1 as varchar) end as dropoff_zone_id,
       case when event_id % 4 = 0 then null else '170310' || cast(user_id as varchar) end as pickup_census_tract,
       round(value * 2) / 2 as fare, event_id % 3 > 1 as shared_matched,
       case event_id % 4 when 0 then true when 1 then false end as shared_requested,
       user_id % 77 + 1 in (56, 76) or case when event_id % 10 = 0 then null else event_id % 77 + 1 in (56, 76) end as airport_trip,
       event_id % 10 = 0 as dropoff_zone_missing, event_id % 4 = 0 as pickup_census_tract_missing_or_suppressed,
       minute(ts) % 15 = 0 as pickup_on_15_minute_grid,
       abs(round_even(round(value * 2) / 2 / 2.5, 0) * 2.5 - round(value * 2) / 2) <= 1e-8 as fare_on_declared_grid,
       cast(15 as integer) as reported_timestamp_rounding_minutes
from events
"""
A_COLUMNS = (
    "source trip_id pickup_datetime pickup_datetime_utc service_date pickup_zone_id dropoff_zone_id "
    "pickup_census_tract fare shared_matched shared_requested airport_trip dropoff_zone_missing "
    "pickup_census_tract_missing_or_suppressed pickup_on_15_minute_grid fare_on_declared_grid "
    "reported_timestamp_rounding_minutes"
).split()


def raw_a(v):
    eid, uid = F.col("event_id"), F.col("user_id")
    flag = F.when(eid % 4 == 0, " Yes").when(eid % 4 == 1, "F").otherwise("maybe")
    return v.events.select(
        eid.cast("string").alias("trip_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:00").alias("trip_start_timestamp"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:00").alias("trip_end_timestamp"),
        F.when(eid % 4 == 0, "  ")
        .otherwise(F.concat(F.lit("170310"), uid.cast("string")))
        .alias("pickup_census_tract"),
        F.lit(None).cast("string").alias("dropoff_census_tract"),
        (uid % 77 + 1).alias("pickup_community_area"),
        F.when(eid % 10 != 0, eid % 77 + 1).alias("dropoff_community_area"),
        (F.round(F.col("value") * 2) / 2).alias("fare"),
        (eid % 3).alias("trips_pooled"),
        flag.alias("shared_trip_authorized"),
    )


@query("P02_normalize_source_a", CLEAN_A_SQL, "fare")
def _(v):
    return TR.normalize_source_a(raw_a(v)).select(*A_COLUMNS).withColumns(
        {
            "pickup_datetime_utc": F.col("pickup_datetime_utc").cast("timestamp_ntz"),
            "reported_timestamp_rounding_minutes": F.col(
                "reported_timestamp_rounding_minutes"
            ).cast("int"),
        }
    )


@query(
    "P03_union_sources",
    f"""
with a as ({CLEAN_A_SQL}), b as ({CLEAN_B_SQL})
select source, count(*) as trips, count(distinct trip_id) as ids, count(fare) as known_fares,
       count(dropoff_zone_id) as known_destinations
from (select source, trip_id, fare, dropoff_zone_id from a
      union all select source, trip_id, fare, dropoff_zone_id from b) u
group by source
""",
)
def _(v):
    both = TR.union_sources(
        TR.normalize_trips(raw_a(v), "chicago_tnp"),
        TR.normalize_trips(raw_b(v), "nyc_hvfhv", source_row=F.col("event_id")),
    )
    TR.check_clean(both)
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_distinct("trip_id").alias("ids"),
        F.count("fare").alias("known_fares"),
        F.count("dropoff_zone_id").alias("known_destinations"),
    )


@query(
    "P04_parse_flag",
    """
select l_orderkey, l_linenumber, case l_returnflag when 'N' then false end as flag,
       case l_linestatus when 'F' then false end as bool
from lineitem
""",
)
def _(v):
    return v.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        C.parse_flag(F.concat(F.lit(" "), F.lower("l_returnflag"))).alias("flag"),
        C.parse_boolean("l_linestatus").alias("bool"),
    )


@query(
    "P05_clean_codes",
    """
select p_partkey, nullif(trim(substr(p_name, 1, 6)), '') as clean_name,
       case when p_partkey % 3 = 0 then null else cast(p_size as varchar) end as zone, nullif(p_partkey % 5, 0) as amount
from part
""",
)
def _(v):
    key = F.col("p_partkey")
    messy = F.when(key % 3 == 0, F.lit("n/a")).otherwise(
        F.concat(F.lit("0"), F.col("p_size").cast("string"), F.lit(".0"))
    )
    text = F.when(key % 5 == 0, "x").otherwise((key % 5).cast("string"))
    return v.part.select(
        "p_partkey",
        C.clean_string(F.concat(F.substring("p_name", 1, 6), F.lit("  "))).alias("clean_name"),
        C.zone_code(messy).alias("zone"),
        text.try_cast("bigint").alias("amount"),
    )


@query(
    "P06_to_utc",
    """
select event_id, ts + interval 5 hour as utc_ny, ts + interval 6 hour as utc_chi, ts - interval 1 hour as utc_paris
from events
""",
)
def _(v):
    return v.events.select(
        "event_id",
        *[
            C.to_utc("ts", tz).cast("timestamp_ntz").alias(name)
            for name, tz in {
                "utc_ny": "America/New_York",
                "utc_chi": "America/Chicago",
                "utc_paris": "Europe/Paris",
            }.items()
        ],
    )


@query(
    "P07_on_grid",
    """
select event_id, minute(ts) % 15 = 0 and millisecond(ts) = 0 as on_quarter_hour,
       abs(value / 0.25 - round(value / 0.25)) * 0.25 <= 1e-8 as on_increment
from events
""",
)
def _(v):
    return v.events.select(
        "event_id",
        C.on_quarter_hour("ts").alias("on_quarter_hour"),
        C.on_increment("value", 0.25).alias("on_increment"),
    )


@query(
    "P08_calendar_parts",
    """
select event_id, cast(ts as date) as service_date, year(ts) as year, month(ts) as month,
       isodow(ts) as day_of_week, hour(ts) as hour, minute(ts) as minute, isodow(ts) >= 6 as is_weekend
from events
""",
)
def _(v):
    return v.events.select("event_id", *[c.alias(n) for n, c in C.calendar_parts("ts").items()])


# --- trade ------------------------------------------------------------------------

cte(
    "staged",
    """
select hs6, hs10, country_code, month_date, con_val_mo, con_cha_mo, dut_val_mo, cal_dut_mo,
       case when unit_qy1 = '-' then null else con_qy1_mo end as con_qy1_mo,
       case when unit_qy1 = '-' then '' else unit_qy1 end as unit_qy1, unit_qy1 = '-' as quantity_not_collected
from trade
""",
)


@query(
    "P09_value_measures",
    """
select hs10, country_code, month_date, con_val_mo + con_cha_mo as cif_value,
       case when con_qy1_mo > 0 then con_val_mo / con_qy1_mo end as customs_unit_value,
       case when con_qy1_mo > 0 then (con_val_mo + cal_dut_mo) / con_qy1_mo end as landed_unit_value_duty_inclusive,
       case when con_qy1_mo > 0 then (con_val_mo + con_cha_mo + cal_dut_mo) / con_qy1_mo end as landed_unit_value_full,
       case when dut_val_mo > 0 then cal_dut_mo / dut_val_mo end as realised_duty_rate_on_dutiable,
       case when con_val_mo > 0 then cal_dut_mo / con_val_mo end as realised_duty_rate_on_customs,
       case when con_val_mo > 0 then con_cha_mo / con_val_mo end as freight_share_of_customs_value
from staged
""",
    "cif_value:4 customs_unit_value:4 landed_unit_value_duty_inclusive:4 landed_unit_value_full:4 "
    "realised_duty_rate_on_dutiable realised_duty_rate_on_customs freight_share_of_customs_value",
)
def _(v):
    return C.value_measures(C.stage_trade(v.trade)).select(
        "hs10",
        "country_code",
        "month_date",
        "cif_value",
        "customs_unit_value",
        "landed_unit_value_duty_inclusive",
        "landed_unit_value_full",
        "realised_duty_rate_on_dutiable",
        "realised_duty_rate_on_customs",
        "freight_share_of_customs_value",
    )


@query("P10_stage_trade", "select * from staged")
def _(v):
    renamed = v.trade.withColumnsRenamed({"con_val_mo": "CON_VAL_MO", "unit_qy1": "UNIT_QY1"})
    return C.stage_trade(renamed, {"CON_VAL_MO": "con_val_mo", "UNIT_QY1": "unit_qy1"})


# --- loans ------------------------------------------------------------------------


@query(
    "P11_derive_origination",
    """
select c_custkey, 'F' as seq_product, 2000 + c_custkey % 25 as seq_orig_year, c_custkey % 4 + 1 as seq_orig_quarter,
       first_payment - interval 2 month as approx_origination_date,
       year(first_payment - interval 2 month) as approx_origination_year
from (select c_custkey, cast(date_trunc('month', min(o_orderdate)) as date) as first_payment
      from customer join orders on c_custkey = o_custkey group by c_custkey) c
""",
)
def _(v):
    from quaymetrics.operators.loans import derive_origination

    key = F.col("o_custkey")
    loans = v.orders.groupBy("o_custkey").agg(
        F.trunc(F.min("o_orderdate").cast("date"), "month").alias("first_payment_date")
    ).join(v.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    seq = F.concat(
        F.lit("F"),
        F.lpad((key % 25).cast("string"), 2, "0"),
        F.lit("Q"),
        (key % 4 + 1).cast("string"),
        key.cast("string"),
    )
    out = derive_origination(loans.withColumn("loan_seq_no", seq))
    return out.select(
        F.col("o_custkey").alias("c_custkey"),
        "seq_product",
        "seq_orig_year",
        "seq_orig_quarter",
        F.col("approx_origination_date").cast("timestamp_ntz").alias("approx_origination_date"),
        "approx_origination_year",
    )


PMT = (
    "case when {n} > 0 then case when abs({r} / 1200) < 1e-12 then {b} / {n} else {b} * ({r} / 1200) * "
    "power(1 + {r} / 1200, {n}) / (power(1 + {r} / 1200, {n}) - 1) end end"
)
cte(
    "rated_loans",
    """
select loan_seq_no, case when loan_seq_no % 23 = 0 then cast(0 as double) else orig_interest_rate end as note_rate,
       orig_upb as balance, cast(orig_loan_term - loan_seq_no % 361 as double) as n, loan_seq_no % 361 as age,
       cast(3 as double) + (loan_seq_no % 11) * cast(0.5 as double) as market_rate, orig_ltv
from originations
""",
)


def rated_loans(v):
    key = F.col("loan_seq_no")
    return v.originations.select(
        "loan_seq_no",
        F.when(key % 23 == 0, 0.0).otherwise(F.col("orig_interest_rate")).alias("note_rate"),
        F.col("orig_upb").alias("balance"),
        (F.col("orig_loan_term") - key % 361).cast("double").alias("n"),
        (key % 361).alias("age"),
        (F.lit(3.0) + (key % 11) * 0.5).alias("market_rate"),
        "orig_ltv",
    )


@query(
    "P12_amortization",
    f"""
select loan_seq_no, {PMT.format(b="balance", r="note_rate", n="n")} as pmt,
       case when age >= 360 then 0 when note_rate = 0 then balance * (1 - age / 360.0::double)
            else balance * (power(1 + note_rate / 1200, 360) - power(1 + note_rate / 1200, age))
                 / (power(1 + note_rate / 1200, 360) - 1) end as scheduled_balance,
       greatest(cast(360 - age as double), 1) as remaining_term,
       (1 - power(1 + 4 / 1200.0::double, -least(84, greatest(360 - age, 1)))) / (4 / 1200.0::double) as annuity
from rated_loans
""",
    "pmt:4 scheduled_balance:3 remaining_term annuity",
)
def _(v):
    age = F.col("age")
    term = L.remaining_term(F.lit(360), age)
    return rated_loans(v).select(
        "loan_seq_no",
        L.payment(F.col("balance"), F.col("note_rate"), F.col("n")).alias("pmt"),
        L.scheduled_balance(F.col("balance"), F.col("note_rate"), F.lit(360.0), age).alias(
            "scheduled_balance"
        ),
        term.alias("remaining_term"),
        L.annuity_factor(F.least(F.lit(84.0), term), 4.0).alias("annuity"),
    )


@query(
    "P13_gap_measures",
    f"""
with g as (
  select loan_seq_no, market_rate - note_rate as rate_gap, n,
         {PMT.format(b="balance", r="market_rate", n="n")} as pm, {PMT.format(b="balance", r="note_rate", n="n")} as pn,
         {PMT.format(b="balance", r="market_rate", n="360")} as pf
  from rated_loans)
select loan_seq_no, rate_gap, greatest(rate_gap, 0) as lockin_gap, -rate_gap as refi_incentive, pm - pn as payment_gap,
       (pm - pn) * (1 - power(1 + 4 / 1200.0::double, -least(84, n))) / (4 / 1200.0::double) as pv_financing_gap,
       cast(case when rate_gap * 100 < -200 then 0 when rate_gap * 100 < -100 then 1 when rate_gap * 100 < 0 then 2
                 when rate_gap * 100 < 100 then 3 when rate_gap * 100 < 200 then 4 when rate_gap * 100 < 300 then 5
                 when rate_gap * 100 < 400 then 6 else 7 end as integer) as gap_bucket,
       pf - pn as payment_gap_fresh_term
from g where n > 0
""",
    "rate_gap lockin_gap refi_incentive payment_gap:4 pv_financing_gap:3 payment_gap_fresh_term:4",
)
def _(v):
    out = L.gap_measures(rated_loans(v).where("n > 0"), term="n", fresh_term=360)
    return out.drop("note_rate", "balance", "n", "age", "market_rate", "orig_ltv")


@query(
    "P14_bucketize",
    """
select o_orderkey, case when o_totalprice < 50000 then 'low' when o_totalprice < 150000 then 'mid'
       when o_totalprice < 300000 then 'high' else 'top' end as band,
       case when month(o_orderdate) < 4 then 0 when month(o_orderdate) < 7 then 1 when month(o_orderdate) < 10 then 2 else 3 end as quarter0
from orders
""",
)
def _(v):
    return v.orders.select(
        "o_orderkey",
        C.bucketize("o_totalprice", [5e4, 1.5e5, 3e5], ["low", "mid", "high", "top"]).alias("band"),
        C.bucketize(F.month("o_orderdate"), [4, 7, 10]).alias("quarter0"),
    )


# --- series -----------------------------------------------------------------------


@query(
    "P15_transform",
    """
select series_id, observation_date, realtime_start, value as level, value - p as difference,
       (value / nullif(p, 0) - 1) * 100 as percent_change, (power(value / nullif(p, 0), 4) - 1) * 100 as annualized,
       (ln(value) - ln(p)) * 100 as log_change
from (select *, lag(value) over (partition by series_id, observation_date order by realtime_start) as p from vintages) s
""",
    "level:2 difference:2 percent_change:4 annualized:1 log_change",
)
def _(v):
    prev = F.lag("value").over(ordered(["series_id", "observation_date"], "realtime_start"))
    df = v.vintages.withColumn("prev", prev)
    cur, p = F.col("value"), F.col("prev")
    return df.select(
        "series_id",
        "observation_date",
        "realtime_start",
        C.transform(cur, p, "level").alias("level"),
        C.transform(cur, p, "difference").alias("difference"),
        C.transform(cur, p, "percent_change").alias("percent_change"),
        C.transform(cur, p, "annualized_percent_change").alias("annualized"),
        C.transform(cur, p, "log_change").alias("log_change"),
    )


RECESSIONS = (
    ("downturn", date(1996, 3, 1), date(1996, 11, 1)),
    ("downturn", date(1999, 12, 1), date(2000, 6, 1)),
)


@query(
    "P16_label_regime",
    """
select o_orderkey, case when cast(o_orderdate as date) between date '1996-03-01' and date '1996-11-01'
       or cast(o_orderdate as date) between date '1999-12-01' and date '2000-06-01' then 'downturn' else 'expansion' end as regime
from orders
""",
)
def _(v):
    return v.orders.select(
        "o_orderkey",
        C.label_regime(F.col("o_orderdate").cast("date"), RECESSIONS, "expansion").alias("regime"),
    )


@query(
    "P17_map_code",
    """
select o_orderkey, case o_orderstatus when 'F' then 'filled' when 'O' then 'open' else 'unknown' end as status_class,
       case when o_orderstatus = 'P' then 'undocumented_code' end as reason
from orders
""",
)
def _(v):
    return v.orders.select(
        "o_orderkey",
        C.map_code("o_orderstatus", {"F": "filled", "O": "open"}, "unknown").alias("status_class"),
        F.when(~F.col("o_orderstatus").isin("F", "O"), "undocumented_code").alias("reason"),
    )


@query(
    "P18_safe_log",
    """
select c_custkey, case when c_acctbal > 0 then ln(c_acctbal) end as log_balance,
       case when c_custkey % 7 > 0 then ln(c_custkey % 7) end as log_count
from customer
""",
    "log_balance log_count",
)
def _(v):
    return v.customer.select(
        "c_custkey",
        C.safe_log("c_acctbal").alias("log_balance"),
        C.safe_log(F.col("c_custkey") % 7).alias("log_count"),
    )


@query(
    "P19_parse_rate",
    """
select l_orderkey, l_linenumber, case when l_linenumber = 1 then 0 when l_linenumber = 2 then null
       when l_linenumber = 3 then null else round(l_tax * 100, 0) / 100 end as rate
from lineitem
""",
    "rate",
)
def _(v):
    pct = F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("%"))
    text = (
        F.when(F.col("l_linenumber") == 1, "Free ")
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("2.5c/kg + "), pct))
        .when(F.col("l_linenumber") == 3, "")
        .otherwise(F.concat(F.lit(" "), pct))
    )
    return v.lineitem.select("l_orderkey", "l_linenumber", C.parse_rate(text).alias("rate"))


@query(
    "P20_effective_availability",
    """
select series_id, observation_date, realtime_start,
       case when day(realtime_start) % 2 = 0 then cast(availability_date as timestamp) + interval 8 hour
            else cast(availability_date as timestamp) + interval 1 day - interval 1 microsecond end as effective_availability
from vintages
""",
)
def _(v):
    exact = F.when(
        F.day("realtime_start") % 2 == 0,
        F.col("availability_date").cast("timestamp") + F.expr("interval 8 hours"),
    )
    return v.vintages.select(
        "series_id",
        "observation_date",
        "realtime_start",
        C.effective_availability(exact, "availability_date")
        .cast("timestamp_ntz")
        .alias("effective_availability"),
    )


cte(
    "aged_months",
    """
select m.loan_seq_no, m.period, m.current_upb, o.orig_upb, o.orig_ltv, o.orig_interest_rate,
       datediff('month', min(m.period) over (partition by m.loan_seq_no), m.period) + 1 as loan_age,
       lag(m.current_upb) over (partition by m.loan_seq_no order by m.period) as prev_upb
from loan_months m join originations o on m.loan_seq_no = o.loan_seq_no
""",
)


def aged_months(v):
    from quaymetrics.operators.loans import add_age

    months = add_age(v.loan_months).join(v.originations, "loan_seq_no")
    return months.withColumn(
        "prev_upb", F.lag("current_upb").over(ordered(["loan_seq_no"], "period"))
    )


@query(
    "P21_est_ltv",
    """
select loan_seq_no, period,
       case when month(period) = 1 then 75.0::double when month(period) % 2 = 0 then orig_ltv * (current_upb / orig_upb) * (100.0::double / (100 + loan_age))
            else orig_ltv * (current_upb / orig_upb) end as est_ltv,
       case when month(period) = 1 then 'freddie_reported_eltv' when month(period) % 2 = 0 then 'orig_ltv_x_amortisation_x_state_hpi'
            else 'orig_ltv_x_amortisation_only' end as ltv_source
from aged_months
""",
    "est_ltv:5",
)
def _(v):
    m = F.month("period")
    value, source = L.est_ltv(
        F.when(m == 1, 75.0),
        F.col("orig_ltv"),
        F.col("current_upb"),
        F.col("orig_upb"),
        F.lit(100.0),
        F.when(m % 2 == 0, (100 + F.col("loan_age")).cast("double")),
    )
    return aged_months(v).select(
        "loan_seq_no", "period", value.alias("est_ltv"), source.alias("ltv_source")
    )


@query(
    "P22_start_balance",
    """
select loan_seq_no, period,
       case when prev_upb > 0 then prev_upb when current_upb > 200000 then current_upb
            else greatest(orig_upb * (power(1 + orig_interest_rate / 1200, 360) - power(1 + orig_interest_rate / 1200, loan_age - 1))
                 / (power(1 + orig_interest_rate / 1200, 360) - 1), 0) end as upb_start_of_month,
       case when prev_upb > 0 then 'prior_month_reported_upb' when current_upb > 200000 then 'same_month_reported_upb'
            else 'scheduled_amortisation' end as upb_timing_source
from aged_months
""",
    "upb_start_of_month:3",
)
def _(v):
    scheduled = L.scheduled_balance(
        F.col("orig_upb"), F.col("orig_interest_rate"), F.lit(360.0), F.col("loan_age") - 1
    )
    current = F.when(F.col("current_upb") > 200000, F.col("current_upb"))
    value, source = L.start_balance(F.col("prev_upb"), current, scheduled)
    return aged_months(v).select(
        "loan_seq_no",
        "period",
        value.alias("upb_start_of_month"),
        source.alias("upb_timing_source"),
    )


@query(
    "P23_forecast_origins",
    """
select series_id || ':' || cast(observation_date as varchar) as forecast_id, series_id as target_series_id,
       observation_date as target_period, r as target_release_timestamp,
       case when day(r) % 2 = 0 then r - interval 1 second
            else cast(cast(r as date) as timestamp) - interval 1 microsecond
                 + case when cast(r as date) - 1 >= make_date(year(cast(r as date) - 1), 4, 1)
                             + cast((7 - isodow(make_date(year(cast(r as date) - 1), 4, 1))) as integer)
                         and cast(r as date) - 1 < make_date(year(cast(r as date) - 1), 10, 31)
                             - cast(isodow(make_date(year(cast(r as date) - 1), 10, 31)) % 7 as integer)
                        then interval 4 hour else interval 5 hour end
       end as forecast_origin
from (select series_id, observation_date, cast(min(realtime_start) as timestamp) + interval 13 hour as r
      from vintages group by series_id, observation_date) f
""",
)
def _(v):
    first = v.vintages.groupBy("series_id", "observation_date").agg(
        (F.min("realtime_start").cast("timestamp") + F.expr("interval 13 hours")).alias(
            "release_timestamp"
        )
    )
    calendar = first.withColumns(
        {
            "release_type": F.lit("initial"),
            "timing_quality": F.when(F.day("release_timestamp") % 2 == 0, "exact").otherwise(
                "date_only"
            ),
        }
    )
    out = VT.forecast_origins(calendar)
    return out.select(
        "forecast_id",
        "target_series_id",
        "target_period",
        F.col("target_release_timestamp").cast("timestamp_ntz").alias("target_release_timestamp"),
        F.col("forecast_origin").cast("timestamp_ntz").alias("forecast_origin"),
    )


cte(
    "daily_signal",
    """
select cast(o_orderdate as date) as service_date, max(o_totalprice) / 20000 as temperature_max_c,
       min(o_totalprice) / 20000 - 3 as temperature_min_c, cast(count(*) % 17 as double) as precipitation_mm,
       cast(count(*) % 3 as double) as snowfall_mm
from orders group by cast(o_orderdate as date)
""",
)


def daily_signal(v):
    n = F.count(F.lit(1))
    return v.orders.groupBy(F.col("o_orderdate").cast("date").alias("service_date")).agg(
        (F.max("o_totalprice") / 20000).alias("temperature_max_c"),
        (F.min("o_totalprice") / 20000 - 3).alias("temperature_min_c"),
        (n % 17).cast("double").alias("precipitation_mm"),
        (n % 3).cast("double").alias("snowfall_mm"),
    )


@query(
    "P24_signal_flags",
    """
select *, (temperature_max_c + temperature_min_c) / 2 as temperature_midrange_c, precipitation_mm >= 1 as wet_day,
       precipitation_mm >= 10 as heavy_precipitation_day, snowfall_mm > 0 as snow_day, temperature_min_c <= 0 as freezing_day,
       precipitation_mm >= 1 or snowfall_mm > 0 as wet_or_snow_day,
       temperature_max_c >= temperature_min_c and precipitation_mm >= 0 and snowfall_mm >= 0 as range_valid
from daily_signal
""",
    "temperature_max_c temperature_min_c temperature_midrange_c precipitation_mm snowfall_mm",
)
def _(v):
    return C.signal_flags(daily_signal(v))


@query(
    "P25_amortization_schedule",
    f"""
with m as (
  select loan_seq_no, k as month, orig_upb as b, orig_interest_rate as r,
         orig_upb * (power(1 + orig_interest_rate / 1200, 360) - power(1 + orig_interest_rate / 1200, k - 1))
           / (power(1 + orig_interest_rate / 1200, 360) - 1) as balance_start,
         orig_upb * (power(1 + orig_interest_rate / 1200, 360) - power(1 + orig_interest_rate / 1200, k))
           / (power(1 + orig_interest_rate / 1200, 360) - 1) as balance_end
  from originations, range(1, 361) t(k))
select loan_seq_no, cast(month as integer) as month, balance_start, balance_end,
       {PMT.format(b="b", r="r", n="360")} as payment, balance_start * r / 1200 as interest,
       {PMT.format(b="b", r="r", n="360")} - balance_start * r / 1200 as principal
from m
""",
    "balance_start:3 balance_end:3 payment:4 interest:4 principal:4",
)
def _(v):
    return L.schedule(
        v.originations, "loan_seq_no", "orig_upb", "orig_interest_rate", "orig_loan_term"
    )
