"""Running counts of a growing trip log: empty source, replay, crash between writes, clean-up."""

import datetime as dt

from pyspark.sql import functions as F

from quaymetrics.operators import experiments as X
from quaymetrics.operators import sets as ST
from quaymetrics.streaming import zones as Z

SCHEMA = (
    "source string, zone_type string, pickup_zone_id string, pickup_datetime timestamp_ntz, "
    "fare double, dropoff_zone_id string"
)
T0 = dt.datetime(2024, 1, 1)


def trips(spark, n, zone="z"):
    return spark.createDataFrame([("a", "b", zone, T0, 1.5, None if k % 2 else "y") for k in range(n)], SCHEMA)


def run(spark, tmp):
    log = spark.readStream.schema(SCHEMA).parquet(f"{tmp}/log")
    out = Z.zone_time_stream(log, f"{tmp}/out", f"{tmp}/state")
    return {r.zone_id: (r.trip_count, r.total_fare, r.od_pair_observed_count) for r in out.collect()}


def test_counts_grow_and_leave_nothing_behind(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert run(spark, tmp_path) == {}
    trips(spark, 4).write.parquet(f"{tmp_path}/log/x1")
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(f"{tmp_path}/log")
    trips(spark, 4).write.mode("append").parquet(f"{tmp_path}/log")
    assert run(spark, tmp_path) == {"z": (4, 6.0, 2)}
    trips(spark, 3).write.mode("append").parquet(f"{tmp_path}/log")
    trips(spark, 1, "new").write.mode("append").parquet(f"{tmp_path}/log")
    assert run(spark, tmp_path) == {"z": (7, 10.5, 4), "new": (1, 1.5, 1)}
    assert run(spark, tmp_path) == {"z": (7, 10.5, 4), "new": (1, 1.5, 1)}
    totals = Z.Totals(spark, f"{tmp_path}/out")
    assert totals.names("deltas") == [] and len(totals.names("totals")) == 1


def test_crashes_and_replays(spark, tmp_path):
    path = str(tmp_path)
    empty = Z.zone_sums(spark.createDataFrame([], trips(spark, 1).schema))
    totals = Z.Totals(spark, path)

    def batch(k, n):
        Z.zone_sums(trips(spark, n)).write.mode("overwrite").parquet(f"{path}/deltas/batch_id={k}")

    def count():
        return [r.trip_count for r in totals.fold(empty).collect()]

    assert count() == []
    batch(0, 2)
    batch(0, 5)  # replayed before it was folded
    assert count() == [5]
    batch(1, 3)
    # a crash after the table and before its manifest: the table does not count
    Z.zone_sums(trips(spark, 99)).write.parquet(f"{path}/totals/upto-1-crashed")
    assert count() == [8] and len(totals.names("totals")) == 1
    # a crash after the manifest and before the clean-up: the folded batch does not count again
    batch(1, 3)
    assert count() == [8] and totals.names("deltas") == []
    # a batch that was not finished does not count
    batch(2, 4)
    (tmp_path / "deltas" / "batch_id=2" / "_SUCCESS").unlink()
    assert count() == [8]


def test_order_of_one_narrow_band(spark):
    df = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("k"), F.lit(1).alias("band"))
    out = ST.total_order(df, ["band", F.desc("k")], "position")
    assert {(r.k, r.position) for r in out.collect()} == {(k, 4000 - k) for k in range(4000)}
    parts = df.repartitionByRange(8, "band", F.desc("k")).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in parts.collect()) < 1500


def test_units_of_a_large_cell(spark):
    cells = spark.createDataFrame([(1, 3_000_000), (2, 0), (3, 5)], "cell int, n long")
    out = {r.cell: r for r in X.assign_individual_shares(cells, "cell", "n", 0.25, "s").collect()}
    assert abs(out[1].treated_units / 3_000_000 - 0.25) < 0.002
    assert out[2].treated_units == 0 and 0 <= out[3].treated_units <= 5
