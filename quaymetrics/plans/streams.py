"""Queries run as streams; their results equal the batch results."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymetrics.registry import query
from quaymetrics.streaming import zones as Z

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def to_trips(events):
    """The trip view over raw events, as columns."""
    eid, uid = F.col("event_id"), F.col("user_id")
    return events.select(
        F.lit("app").alias("source"),
        F.lit("user20").alias("zone_type"),
        eid.cast("string").alias("trip_id"),
        F.col("ts").alias("pickup_datetime"),
        (uid % 20).cast("string").alias("pickup_zone_id"),
        F.when(eid % 10 != 0, ((uid * 7 + eid) % 20).cast("string")).alias("dropoff_zone_id"),
        F.when(eid % 13 != 0, F.col("value")).alias("fare"),
        (F.col("event_type") == "purchase").alias("shared_requested"),
    )


def event_stream(v):
    return Z.read_log(v.spark, v.sf_dir, EVENTS, "events.parquet")


@query("X01_ingest_stream", "select * from event_trips")
def _(v):
    path, checkpoint = Z.places(v.spark, "ingest")
    out = Z.ingest_stream(event_stream(v), to_trips, path, checkpoint)
    return out.drop("batch_id")


@query(
    "X01_reconcile",
    "select count(*) as ingested_rows, count(*) as source_rows, true as reconciled from events",
)
def _(v):
    path, checkpoint = Z.places(v.spark, "ingest")
    out = Z.ingest_stream(event_stream(v), to_trips, path, checkpoint)
    return Z.reconcile_rows(out, v.events)


@query(
    "X02_zone_time_stream",
    """
select source, zone_type, pickup_zone_id as zone_id, time_bucket(interval 15 minute, pickup_datetime) as time_bin, count(*) as trip_count, sum(fare) as total_fare,
       count(dropoff_zone_id) as od_pair_observed_count from event_trips group by 1, 2, 3, 4
""",
    "total_fare:2",
)
def _(v):
    path, checkpoint = Z.places(v.spark, "zone-counts")
    return Z.zone_time_stream(to_trips(event_stream(v)), path, checkpoint)
