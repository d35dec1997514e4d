"""Test-data views: the library's input shapes derived from the given tables.

`VIEW_SQL` is written in the common subset of Spark SQL and DuckDB, so the same text feeds
the Spark views and the oracle's common table expressions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymetrics.session import shared_dir

_STORED: dict[tuple[str, str, str], str] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEW_SQL = {
    "trips": """
select 'fleet' as source, 'nation' as zone_type,
       cast(l_orderkey as string) || ':' || cast(l_linenumber as string) as trip_id,
       o_orderdate as pickup_datetime, l_shipdate as dropoff_datetime,
       case when c_nationkey = 24 then null else cast(c_nationkey as string) end as pickup_zone_id,
       case when s_nationkey = 24 then null else cast(s_nationkey as string) end as dropoff_zone_id,
       l_extendedprice as fare, l_extendedprice * l_discount as tips, l_quantity as trip_miles,
       l_returnflag = 'R' as shared_requested, l_linestatus = 'F' as shared_matched
from lineitem join orders on l_orderkey = o_orderkey
     join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
""",
    "event_trips": """
select 'app' as source, 'user20' as zone_type, cast(event_id as string) as trip_id, ts as pickup_datetime,
       cast(user_id % 20 as string) as pickup_zone_id,
       case when event_id % 10 = 0 then null else cast((user_id * 7 + event_id) % 20 as string) end as dropoff_zone_id,
       case when event_id % 13 = 0 then null else value end as fare,
       event_type = 'purchase' as shared_requested
from events
""",
    "trade": """
select lpad(cast(l_partkey % 20 as string), 6, '0') as hs6,
       lpad(cast(l_partkey % 20 as string), 6, '0') || lpad(cast(l_partkey % 40 as string), 4, '0') as hs10,
       cast(s_nationkey % 5 as string) as country_code, cast(date_trunc('month', l_shipdate) as date) as month_date,
       round(sum(l_extendedprice), 2) as con_val_mo, round(sum(l_extendedprice * l_discount), 4) as con_cha_mo,
       round(sum(case when l_tax > 0 then l_extendedprice else 0 end), 2) as dut_val_mo,
       round(sum(l_extendedprice * l_tax), 4) as cal_dut_mo, sum(l_quantity) as con_qy1_mo,
       case when l_partkey % 40 % 7 = 0 then '-' when l_partkey % 40 % 3 = 0 then 'NO' else 'KG' end as unit_qy1
from lineitem join supplier on l_suppkey = s_suppkey
group by l_partkey % 20, l_partkey % 40, s_nationkey % 5, date_trunc('month', l_shipdate)
""",
    "tariff_records": """
select 'a' || cast(k as string) as record_id,
       case when k <= 5 then 'A1' when k <= 10 then 'A2' else 'A3' end as action_id, 'ADDITIONAL_DUTY' as record_type,
       lpad(cast(k as string), 6, '0') || '00' as product_code, '3' as partner_country_code,
       case when k <= 5 then date '1997-07-06' when k <= 10 then date '1998-08-23' else date '1998-09-24' end as effective_date,
       cast(null as date) as expiry_date,
       case when k <= 5 then cast(0.25 as double) else cast(0.10 as double) end as ad_valorem_rate, k = 12 as partial_line
from (select distinct l_partkey % 20 as k from lineitem) p where k between 1 and 13
union all select * from (values
  ('r2','A1','RATE_CHANGE','00000100','3',date '1999-05-10',cast(null as date),cast(0.30 as double),false),
  ('r4','A2','EXCLUSION','00000600','3',date '1999-01-01',date '1999-12-31',cast(null as double),false),
  ('r5','A2','EXCLUSION','00000700','3',date '1999-01-01',cast(null as date),cast(null as double),false),
  ('r6','A2','REINSTATEMENT','00000700','3',date '1999-06-15',cast(null as date),cast(null as double),false),
  ('r7','A4','ADDITIONAL_DUTY','00000800','3',date '2000-02-14',cast(null as date),cast(0.15 as double),false)
) as t(record_id, action_id, record_type, product_code, partner_country_code, effective_date, expiry_date, ad_valorem_rate, partial_line)
""",
    "originations": """
select c_custkey as loan_seq_no, cast(2.5 as double) + (c_custkey % 17) * cast(0.25 as double) as orig_interest_rate,
       cast(100000 as double) + cast(1000 as double) * (c_custkey % 300) as orig_upb, 360 as orig_loan_term,
       60 + c_custkey % 40 as orig_ltv,
       cast(c_nationkey as string) as property_state, substr(c_mktsegment, 1, 1) as loan_purpose,
       case when c_custkey % 50 = 0 then null else 600 + c_custkey % 200 end as credit_score
from customer
""",
    "loan_months": """
select o_custkey as loan_seq_no, cast(date_trunc('month', o_orderdate) as date) as period,
       round(sum(o_totalprice), 2) as current_upb, count(*) as n_rows,
       max(case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then '01'
                when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' then '03'
                when o_orderstatus = 'P' then '15' end) as zero_balance_code
from orders group by o_custkey, date_trunc('month', o_orderdate)
""",
    "weekly_rates": """
select cast(date_trunc('week', o_orderdate) as date) as date,
       round(cast(3 as double) + avg(o_totalprice) / cast(100000 as double), 6) as pmms30
from orders group by date_trunc('week', o_orderdate)
""",
    "vintages": """
select series_id, observation_date, realtime_start, realtime_start as availability_date,
       case when day(realtime_start) % 11 = 0 then null
            else round(sum(v) over (partition by series_id, observation_date order by realtime_start), 2) end as value
from (select o_orderpriority as series_id, cast(date_trunc('month', o_orderdate) as date) as observation_date,
             cast(l_shipdate as date) as realtime_start, sum(l_extendedprice) as v
      from lineitem join orders on l_orderkey = o_orderkey
      group by o_orderpriority, date_trunc('month', o_orderdate), cast(l_shipdate as date)) s
""",
    "forecasts": """
select series_id, period, model_id, actual, prediction
from (select series_id, period, actual, 'lag1' as model_id,
             lag(actual, 1) over (partition by series_id order by period) as prediction from
        (select o_orderpriority as series_id, cast(date_trunc('month', o_orderdate) as date) as period, round(sum(o_totalprice), 2) as actual
         from orders group by o_orderpriority, date_trunc('month', o_orderdate)) a
      union all
      select series_id, period, actual, 'historical_mean' as model_id,
             avg(actual) over (partition by series_id order by period rows between unbounded preceding and 1 preceding) as prediction from
        (select o_orderpriority as series_id, cast(date_trunc('month', o_orderdate) as date) as period, round(sum(o_totalprice), 2) as actual
         from orders group by o_orderpriority, date_trunc('month', o_orderdate)) b) u
where prediction is not null
""",
    "mc_records": """
select l_returnflag as design, l_linestatus as estimator, l_discount as estimate,
       cast(0.02 as double) + l_tax / 10 as std_error, cast(0.05 as double) as truth, l_tax as scenario
from lineitem
""",
}

# Aggregated inputs that plans read several times; each is staged once per session.
STAGED = ("trade", "tariff_records", "loan_months", "weekly_rates", "vintages")

# The treatment panel crosses nations with the observed calendar months (at most twelve).
ASSIGNMENTS_SQL = """
select n_nationkey as zone_id, p.period_id, cast(floor(n_nationkey / 5) as int) as cluster_id,
       cast((n_nationkey * 31 + cast(floor(p.period_id / 3) as int) * 17) % 2 as int) as assigned_treatment
from nation cross join (select distinct month(o_orderdate) - 1 as period_id from orders) p
"""


class Views:
    """Lazy access to the given tables and the derived views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in STAGED:
            return self.stored(name, lambda: self.sql(VIEW_SQL[name]))
        if name in VIEW_SQL:
            return self.sql(VIEW_SQL[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the given tables, each bound as a named argument."""
        used = {t: self.table(t) for t in TABLES if re.search(rf"\b(from|join)\s+{t}\b", text)}
        for t in used:
            text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}} as {t}", text)
        return self.spark.sql(text, **used)

    def state(self) -> tuple:
        """Names, sizes and times of the given tables: new data makes new layers."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        found = where.getFileSystem(conf).listStatus(where)
        return tuple(
            sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found)
        )

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived layer written once to the shared folder and read back from there.

        Layers live as long as the session that wrote them; executors may come and go.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, self.state())
        if key not in _STORED:
            path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
            build().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @cached_property
    def assignments(self) -> DataFrame:
        months = self.orders.agg(
            F.collect_set(F.month("o_orderdate") - 1).alias("months")
        ).scalar()
        zone = F.col("zone_id")
        return (
            self.nation.select(
                F.col("n_nationkey").alias("zone_id"), F.explode(months).alias("period_id")
            )
            .withColumn("cluster_id", F.floor(zone / 5).cast("int"))
            .withColumn(
                "assigned_treatment",
                ((zone * 31 + F.floor(F.col("period_id") / 3).cast("int") * 17) % 2).cast("int"),
            )
        )
