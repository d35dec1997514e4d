"""Queries for readers, writers and table summaries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymetrics.registry import query
from quaymetrics.sources import io

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("toll", T.DoubleType()),
    ]
)
NATION_SCHEMA = T.StructType(
    [
        T.StructField("n_nationkey", T.IntegerType()),
        T.StructField("n_name", T.StringType()),
        T.StructField("n_regionkey", T.IntegerType()),
    ]
)
# Two layouts of the performance file, told apart by their field count.
PERFORMANCE_SHORT = T.StructType(
    [
        T.StructField("loan_seq_no", T.LongType()),
        T.StructField("period", T.DateType()),
        T.StructField("current_upb", T.DoubleType()),
    ]
)
PERFORMANCE_FULL = T.StructType(
    [
        *PERFORMANCE_SHORT.fields,
        T.StructField("n_rows", T.LongType()),
        T.StructField("zero_balance_code", T.StringType()),
    ]
)


@query(
    "S01_read_trips",
    "select event_id, ts, user_id, value, cast(null as double) as toll from events",
)
def _(v):
    return io.read_trips(
        v.spark, [f"{v.sf_dir}/events.parquet"], EVENT_SCHEMA, ["event_id", "ts", "value"]
    )


@query("S02_read_csv", "select n_nationkey, n_name, n_regionkey from nation")
def _(v):
    path = io.scratch(v.spark, "nation-csv")
    v.nation.write.csv(path, header=True)
    return io.read_csv(v.spark, path, NATION_SCHEMA)


@query(
    "S03_read_piped",
    """
select loan_seq_no, period, current_upb, case when loan_seq_no % 5 > 0 then n_rows end as n_rows,
       case when loan_seq_no % 5 > 0 and loan_seq_no % 97 > 0 then zero_balance_code end as zero_balance_code,
       case when loan_seq_no % 5 > 0 then 'full' else 'short' end as layout,
       case when loan_seq_no % 5 = 0 and loan_seq_no % 95 = 0 then 1 else 0 end as extra_fields
from loan_months
""",
)
def _(v):
    # Two cohorts of files: full ones, in which loans divisible by 97 are one field short, as
    # truncated lines are in real files; and short ones, some lines of which have a field too many.
    path = io.scratch(v.spark, "loan-text")
    parts = [F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in PERFORMANCE_FULL]
    loan = F.col("loan_seq_no")
    full = F.when(loan % 97 == 0, F.concat_ws("|", *parts[:-1])).otherwise(F.concat_ws("|", *parts))
    short = F.concat_ws("|", *parts[: len(PERFORMANCE_SHORT)])
    short = F.when(loan % 95 == 0, F.concat_ws("|", short, F.lit("x"))).otherwise(short)
    for name, line, rows in (("full", full, loan % 5 > 0), ("short", short, loan % 5 == 0)):
        v.loan_months.where(rows).select(line.alias("value")).write.text(f"{path}/cohort={name}")
    layouts = {"short": PERFORMANCE_SHORT, "full": PERFORMANCE_FULL}
    return io.read_piped(v.spark, f"{path}/*", layouts)


@query(
    "S04_flatten_vintages",
    """
select 'user' || cast(user_id as varchar) as series_id, 'units' as units,
       cast(ts as date) as observation_date, cast(ts as date) as realtime_start,
       cast(null as date) as realtime_end, cast(ts as date) as availability_date,
       case when event_id % 7 = 0 then null else value end as value
from events
union all
select 'user' || cast(user_id as varchar), 'units', cast(ts as date),
       cast(ts as date) + 1, cast(ts as date) + 30, cast(ts as date) + 2,
       cast(json_extract_string(props, '$.k') as double)
from events
""",
)
def _(v):
    day = F.to_date("ts")
    first = F.struct(
        day.cast("string").alias("date"),
        day.cast("string").alias("realtime_start"),
        F.lit(None).cast("string").alias("realtime_end"),
        F.lit(None).cast("string").alias("release_date"),
        F.when(F.col("event_id") % 7 == 0, F.lit("."))
        .otherwise(F.col("value").cast("string"))
        .alias("value"),
    )
    second = F.struct(
        day.cast("string").alias("date"),
        F.date_add(day, 1).cast("string").alias("realtime_start"),
        F.date_add(day, 30).cast("string").alias("realtime_end"),
        F.date_add(day, 2).cast("string").alias("release_date"),
        F.get_json_object("props", "$.k").alias("value"),
    )
    docs = v.events.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("series_id"),
                F.lit("units").alias("units"),
                F.array(first, second).alias("observations"),
            )
        ).alias("payload")
    )
    return io.flatten_vintages(docs, "payload")


@query(
    "S05_partitioned_scan",
    """
select loan_seq_no, period, current_upb, year(period) as period_year
from loan_months where year(period) in (1996, 1997)
""",
)
def _(v):
    path = io.scratch(v.spark, "loan-months")
    io.write_partitioned(
        v.loan_months.withColumn("period_year", F.year("period")),
        path,
        ["period_year"],
        ["loan_seq_no", "period"],
    )
    return io.scan(v.spark, path, F.col("period_year").isin(1996, 1997)).select(
        "loan_seq_no", "period", "current_upb", "period_year"
    )


@query(
    "S06_write_partitioned",
    """
select year(o_orderdate) as year, month(o_orderdate) as month, o_orderkey, o_totalprice
from orders where year(o_orderdate) >= 1997
""",
)
def _(v):
    path = io.scratch(v.spark, "orders")
    base = v.orders.select(
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        "o_orderkey",
        "o_totalprice",
    )
    io.write_partitioned(base.where("year < 1997"), path, ["year", "month"], ["o_orderkey"])
    # The second write must leave no partition of the first behind.
    io.write_partitioned(base.where("year >= 1997"), path, ["year", "month"], ["o_orderkey"])
    return v.spark.read.parquet(path)


@query(
    "S07_write_csv",
    """
select o_orderpriority, count(*) as n_orders, sum(o_totalprice) as total
from orders group by o_orderpriority
""",
    "total:2",
)
def _(v):
    path = io.scratch(v.spark, "summary-csv")
    table = v.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total")
    )
    io.write_csv(table, path, ["o_orderpriority"])
    return v.spark.read.schema(table.schema).csv(path, header=True)


@query(
    "S08_registered_sql",
    """
select series_id, count(*) as vintages, count(value) as known, max(availability_date) as last_release
from vintages group by series_id
""",
)
def _(v):
    io.register(v.vintages, io.scratch(v.spark, "vintages"), "vintage_store")
    return v.spark.sql(
        "select series_id, count(*) as vintages, count(value) as known, "
        "max(availability_date) as last_release from vintage_store group by series_id"
    )


@query(
    "S09_profile",
    """
select count(*) as row_count, min(month_date) as coverage_min, max(month_date) as coverage_max,
       count(distinct (hs10, country_code)) as distinct_keys,
       count(*) - count(hs10) as nulls_hs10, count(*) - count(country_code) as nulls_country_code,
       count(*) - count(month_date) as nulls_month_date, count(*) - count(con_val_mo) as nulls_con_val_mo,
       count(*) - count(nullif(unit_qy1, '-')) as nulls_unit
from trade
""",
)
def _(v):
    df = v.trade.select(
        "hs10",
        "country_code",
        "month_date",
        "con_val_mo",
        F.nullif("unit_qy1", F.lit("-")).alias("unit"),
    )
    return io.profile(df, ["hs10", "country_code"], "month_date")


@query(
    "S10_fingerprint",
    """
select count(*) as row_count,
       cast(sum(('0x' || substr(md5(concat_ws('|', length(cast(o_orderkey as varchar)) || ':' || cast(o_orderkey as varchar),
           length(cast(o_custkey as varchar)) || ':' || cast(o_custkey as varchar), length(o_orderstatus) || ':' || o_orderstatus,
           length(o_orderpriority) || ':' || o_orderpriority)), 1, 8))::bigint) as bigint) as md5_sum
from orders
""",
)
def _(v):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return io.fingerprint(v.orders, cols).drop("xxhash_sum", "xxhash_xor")


@query("S10_fingerprint_xxhash")
def _(v):
    return io.fingerprint(v.lineitem)
