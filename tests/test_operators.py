"""Small known-answer tests of rules the SQL comparison does not reach."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymetrics.core import (
    asof_backward,
    hash32,
    hash_rank,
    quantiles,
    running_total,
    table_quantiles,
)
from quaymetrics.functions import columns as C
from quaymetrics.functions import lending as L
from quaymetrics.operators import areas as AR
from quaymetrics.operators import estimators as E
from quaymetrics.operators import experiments as X
from quaymetrics.operators import joins as J
from quaymetrics.operators import mobility as MB
from quaymetrics.operators import policy as PO
from quaymetrics.operators import vintage as VT
from quaymetrics.operators import windows as W


def test_quantiles_match_numpy_on_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 50)) for _ in range(900)] + [("cold", float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.97}).collect()}
    for k in ("hot", "cold"):
        values = [v for g, v in rows if g == k]
        assert np.allclose([got[k][n] for n in "abc"], np.quantile(values, [0.1, 0.5, 0.97]))


def test_running_total_and_rank_are_exact_across_buckets(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), "id", (F.col("id") / 50).cast("int").alias("b"))
    out = running_total(df, ["k"], "b", ["id"], F.col("id"), "run").orderBy("k", "id").collect()
    for k in (0, 1):
        mine = [r for r in out if r["k"] == k]
        assert [r["run"] for r in mine] == list(np.cumsum([r["id"] for r in mine]))
    ranks = hash_rank(df, [], hash32("id"), ["id"], "r").select("r").collect()
    assert sorted(r["r"] for r in ranks) == list(range(1, 501))


def test_asof_takes_the_last_earlier_row_even_when_its_value_is_null(spark):
    d = dt.date
    left = spark.createDataFrame([(1, d(2020, 5, 1)), (1, d(2019, 1, 1)), (2, d(2020, 5, 1))], "k int, t date")
    right = spark.createDataFrame(
        [(1, d(2020, 1, 3), 1.0), (1, d(2020, 3, 9), None), (2, d(2020, 6, 1), 9.0)], "k int, s date, v double"
    ).withColumn("at", F.col("s"))
    got = {(r["k"], r["t"]): (r["v"], r["at"]) for r in asof_backward(left, right, "t", "s", ["v", "at"], ["k"]).collect()}
    assert got[1, d(2020, 5, 1)] == (None, d(2020, 3, 9))
    assert got[1, d(2019, 1, 1)] == (None, None)
    assert got[2, d(2020, 5, 1)] == (None, None)


def test_clock_changes_give_no_utc_time(spark):
    texts = ["2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-07-01 12:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz"))
    got = [r[0] for r in df.select(C.to_utc("t", "America/New_York").cast("timestamp_ntz")).collect()]
    assert got == [None, None, dt.datetime(2024, 7, 1, 16, 0)]


def test_rate_text(spark):
    df = spark.createDataFrame([("Free",), (" 3.5% ",), ("2c/kg + 5%",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.parse_rate("t")).collect()] == [0.0, 0.035, None, None, None]


def vintages(spark):
    d = dt.date
    rows = [
        ("s", d(2020, 1, 1), d(2020, 2, 5), 10.0),
        ("s", d(2020, 1, 1), d(2020, 3, 5), None),
        ("s", d(2020, 2, 1), d(2020, 3, 5), 12.0),
    ]
    df = spark.createDataFrame(rows, "series_id string, observation_date date, realtime_start date, value double")
    return df.withColumn("availability_date", F.col("realtime_start"))


def test_null_latest_vintage_wins_and_day_is_closed(spark):
    v = vintages(spark)
    early = VT.as_of(v, "2020-03-05 12:00:00").collect()
    assert [(r["observation_date"], r["value"]) for r in early] == [(dt.date(2020, 1, 1), 10.0)]
    late = {r["observation_date"]: r["value"] for r in VT.as_of(v, "2020-03-06 00:00:00").collect()}
    assert late == {dt.date(2020, 1, 1): None, dt.date(2020, 2, 1): 12.0}
    VT.assert_no_future(VT.as_of(v, "2020-03-05 12:00:00"))
    with pytest.raises(ValueError):
        VT.assert_no_future(VT.naive_latest(v, "2020-02-01 00:00:00"))


RECORDS = (
    "record_id string, action_id string, record_type string, product_code string, partner_country_code string, "
    "effective_date date, expiry_date date, ad_valorem_rate double, partial_line boolean, partial_line_excluded_codes array<string>"
)


def assess(spark, records, product="12345678", day=dt.date(2019, 6, 1)):
    keys = spark.createDataFrame([(product, "C", day)], "product string, country string, as_of date")
    return PO.assess_lines(keys, spark.createDataFrame(records, RECORDS)).first()


def test_policy_dates_conflicts_and_reinstatement(spark):
    d = dt.date
    duty = ("a", "A1", "ADDITIONAL_DUTY", "12345678", "C", d(2019, 1, 1), d(2019, 6, 1), 0.25, False, None)
    assert assess(spark, [duty], day=d(2019, 1, 1))["additional_rate"] == 0.25
    assert assess(spark, [duty], day=d(2018, 12, 31))["status"] == "NO_MATCH"
    assert assess(spark, [duty], day=d(2019, 6, 1))["status"] == "NO_MATCH"
    open_duty = duty[:6] + (None,) + duty[7:]
    other = ("b", "A2", "ADDITIONAL_DUTY", "12345678", "C", d(2019, 2, 1), None, 0.10, False, None)
    row = assess(spark, [open_duty, other])
    assert (row["status"], row["additional_rate"], row["active_actions"]) == ("CONFLICT", None, "A1|A2")
    out = ("x", "A1", "EXCLUSION", "12345678", "C", d(2019, 3, 1), None, None, False, None)
    assert assess(spark, [open_duty, out])["status"] == "EXCLUDED"
    back = ("r", "A1", "REINSTATEMENT", "12345678", "C", d(2019, 4, 1), None, None, False, None)
    assert assess(spark, [open_duty, out, back])["additional_rate"] == 0.25


def test_named_carve_out_is_exact_at_ten_digits(spark):
    d = dt.date
    duty = ("a", "A1", "ADDITIONAL_DUTY", "12345678", "C", d(2019, 1, 1), None, 0.25, True, ["1234567890"])
    other = ("b", "A2", "ADDITIONAL_DUTY", "12345678", "C", d(2019, 1, 1), None, 0.10, False, None)
    assert assess(spark, [duty], "1234567890")["additional_rate"] == 0.0
    assert assess(spark, [duty], "1234567800")["status"] == "OK"
    assert assess(spark, [duty], "12345678")["status"] == "PARTIAL_LINE"
    assert assess(spark, [duty, other], "1234567890")["additional_rate"] == 0.10


def test_duplicate_lookup_keys_fail(spark):
    panel = spark.createDataFrame([(1,)], "k int")
    source = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        J.enrich(panel, [J.Enrichment("x", source, ["k"])])


def test_greedy_allocation_skips_what_does_not_fit(spark):
    rows = [("m", i, float(c), float(s)) for i, (c, s) in enumerate([(5, 50), (4, 36), (6, 48), (1, 5), (2, 9), (1, -1)])]
    df = spark.createDataFrame(rows, "market string, item int, cost double, score double")
    out = W.allocate_ranked(df, "market", "score", "cost", "item", F.lit(10.0)).orderBy("item").collect()
    left, want = 10.0, {}
    for _, i, c, s in sorted(rows, key=lambda r: (-r[3] / r[2], r[1])):
        want[i] = int(s > 0 and c <= left)
        left -= c * want[i]
    assert [r["selected"] for r in out] == [want[i] for i in range(len(rows))]


def test_greedy_allocation_over_many_rounds(spark):
    rng = np.random.default_rng(5)
    draws = [(int(rng.integers(3)), float(rng.integers(1, 900)), float(rng.integers(-100, 999))) for _ in range(3000)]
    rows = [(m, i, c, s) for i, (m, c, s) in enumerate(draws)] + [(1, 3000 + i, 1.0, 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "market int, item int, cost double, score double")
    out = W.allocate_ranked(df, "market", "score", "cost", "item", F.lit(5000.0)).collect()
    left, want = dict.fromkeys(range(3), 5000.0), set()
    for m, i, c, s in sorted(rows, key=lambda r: (-r[3] / r[2], r[1])):
        if s > 0 and c <= left[m]:
            left[m] -= c
            want.add(i)
    assert len(out) == len(rows)
    assert {r["item"] for r in out if r["selected"]} == want


def test_event_calendar_lists_every_major_name(spark):
    d = dt.date
    rows = [(1, d(2020, 1, 1), "b", True, True), (2, d(2020, 1, 1), "a", False, True), (3, d(2020, 1, 1), "b", True, True), (4, d(2020, 1, 2), "c", True, False)]
    days = spark.createDataFrame(rows, "event_id int, service_date date, event_name string, public boolean, major boolean")
    got = AR.event_calendar(days, "2020-01-01", "2020-01-03").orderBy("service_date").collect()
    assert [r["major_names"] for r in got] == ["a | b", "", ""]
    assert [r["n_major_names"] for r in got] == [2, 0, 0]


def test_schedule_deals_a_small_table_over_tasks(spark):
    loans = spark.range(6, numPartitions=1).select("id", F.lit(1000.0).alias("b"), F.lit(6.0).alias("r"), F.lit(12).alias("n"))
    out = L.schedule(loans, "id", "b", "r", "n", months_per_task=12)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    rows = out.where("id = 3").orderBy("month").collect()
    assert [r["month"] for r in rows] == list(range(1, 13))
    assert rows[-1]["balance_end"] == 0.0
    assert sum(r["principal"] for r in rows) == pytest.approx(1000.0)
    assert L.schedule(loans.where("id < 0"), "id", "b", "r", "n").count() == 0


def test_trip_moments_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def fare(i):
        made.add(1)
        return float(i)

    rows = spark.range(50).select(
        F.udf(fare, "double")("id").alias("fare"), F.sqrt("id").alias("pay"), F.lit(2.0).alias("wait")
    )
    out = MB.trip_moments(rows, "wait", "fare", "pay").first()
    assert (out["fare_p50"], out["fare_max"], out["trip_rows"]) == (24.5, 49.0, 50)
    assert made.value == 50


def test_two_effect_ols_recovers_a_slope_and_matches_dummies(spark):
    rng = np.random.default_rng(3)
    rows = [
        (int(u), int(t), float(x), float(2.5 * x + 3 * u - t + rng.normal(0, 0.1)))
        for u in range(12)
        for t in range(10)
        if (u + t) % 5
        for x in [rng.normal()]
    ]
    df = spark.createDataFrame(rows, "u int, t int, x double, y double").withColumn("g", F.col("u"))
    got = E.ols_hdfe(df, "y", ["x"], ["u", "t"], ["g"]).first()
    a = np.array(rows)
    dummies = [(a[:, 0] == u).astype(float) for u in range(12)] + [(a[:, 1] == t).astype(float) for t in range(1, 10)]
    beta = np.linalg.lstsq(np.column_stack([a[:, 2], *dummies]), a[:, 3], rcond=None)[0]
    assert abs(got["estimate"] - beta[0]) < 1e-6
    assert abs(got["estimate"] - 2.5) < 0.1


def test_student_tail():
    assert abs(E.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(E.t_two_sided(1.0, 1) - 0.5) < 1e-10


def test_synthetic_weights_find_the_mixture():
    paths = np.random.default_rng(0).normal(size=(20, 4))
    target = paths @ np.array([0.7, 0.3, 0.0, 0.0])
    w, converged = E.simplex_weights(paths.T @ paths, paths.T @ target)
    assert converged
    assert np.allclose(w, [0.7, 0.3, 0, 0], atol=1e-4)


def test_balanced_counts_use_every_cluster():
    assert sum(X.balanced_counts(8, [1 / 3] * 3)) == 8
    with pytest.raises(ValueError):
        X.balanced_counts(2, [1 / 3] * 3)


def test_repeated_edges_count_once_each(spark):
    from quaymetrics.operators.quality import edge_checks

    rows = [("a", "b", 1.0), ("b", "a", 1.0)] * 3 + [("c", "d", 1.0), ("c", "c", 2.0)]
    edges = spark.createDataFrame(rows, "focal_zone_id string, neighbor_zone_id string, weight double")
    got = edge_checks(edges).first().asDict()
    assert (got["edges"], got["duplicate_pairs"], got["self_edges"], got["asymmetric_edges"]) == (8, 4, 1, 1)


def test_fingerprint_tells_rows_and_repeats_apart(spark):
    from quaymetrics.sources.io import fingerprint

    def of(*rows):
        row = fingerprint(spark.createDataFrame(rows, "a string, b string")).first()
        return row["md5_sum"], row["xxhash_sum"]

    assert of(("a|", "b")) != of(("a", "|b"))
    assert of(("a", "b"), ("a", "b")) != of(("c", "d"), ("c", "d"))
    assert of(("a", "b"), ("c", None)) == of(("c", None), ("a", "b"))


def test_unknown_layout_is_an_error(spark, tmp_path):
    from pyspark.sql import types as T

    from quaymetrics.sources.io import read_piped

    (tmp_path / "x.txt").write_text("1|2|3\n")
    two = T.StructType().add("a", T.LongType()).add("b", T.LongType())
    with pytest.raises(ValueError, match="no layout has 3 fields"):
        read_piped(spark, str(tmp_path), {"two": two})


def test_unfinished_projection_is_told(spark):
    import os

    from quaymetrics.operators import estimators as E
    from quaymetrics.session import shared_dir

    rows = [(i % 7, (i * i) % 5, float(i % 11), float((i * 7) % 13)) for i in range(200)]
    df = spark.createDataFrame(rows, "f int, g int, x double, y double")
    short = E.ols_hdfe(df, "y", ["x"], ["f", "g"], max_iter=1).first()
    assert not short["converged"]
    root = shared_dir(spark)
    before = set(os.listdir(root))
    full = E.ols_hdfe(df, "y", ["x"], ["f", "g"]).first()
    assert full["converged"] and full["rounds"] > 1
    # of all rounds at most the last one's table is left
    assert len(set(os.listdir(root)) - before) <= 1


def test_separated_arms_are_an_error(spark):
    from quaymetrics.operators import estimators as E

    rows = [(i, float(i >= 50), float(i), float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, t double, x double, y double")
    with pytest.raises(ValueError):
        E.aipw(df, "y", "t", ["x"], "id", folds=2).collect()


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quaymetrics.session import shared_dir

    remote = SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d: d),
        sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(remote)


def test_late_rows_and_later_runs_are_counted(spark, tmp_path):
    from quaymetrics.streaming import zones as Z

    schema = (
        "source string, zone_type string, pickup_zone_id string, pickup_datetime timestamp_ntz, "
        "dropoff_zone_id string, fare double"
    )

    def land(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        log = Z.read_log(spark, str(tmp_path / "in"), _parse(schema), "*.parquet", max_files=1)
        out = Z.zone_time_stream(log, str(tmp_path / "out"), str(tmp_path / "state"))
        return {(r["zone_id"], r["time_bin"]): (r["trip_count"], r["total_fare"]) for r in out.collect()}

    day = dt.datetime(2024, 1, 2)
    land("a", [("s", "z", "1", day, None, 1.0), ("s", "z", "1", day + dt.timedelta(days=3), "2", 2.0)])
    first = run()
    assert first[("1", day)] == (1, 1.0)
    assert run() == first  # nothing new
    land("b", [("s", "z", "1", day, "2", 5.0), ("s", "z", "2", day, "2", None)])  # days late
    later = run()
    assert later[("1", day)] == (2, 6.0) and later[("2", day)] == (1, None) and len(later) == 3


def _parse(schema):
    from pyspark.sql import types as T

    return T._parse_datatype_string(schema)


def test_zone_correlations_match_numpy(spark, monkeypatch):
    from quaymetrics.operators import mobility as MB

    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 30)
    rows = [
        (f"z{z}", start + dt.timedelta(hours=h), int(rng.integers(0, 9)) if z else 4)
        for h in range(120) for z in range(7) if rng.random() < 0.8
    ]
    panel = spark.createDataFrame(rows, "zone_id string, time_bin timestamp_ntz, trip_count long")
    got = {(r.origin_zone, r.comparison_zone): r.demand_correlation for r in MB.cross_zone_correlation(panel).collect()}
    by = {}
    for z, t, y in rows:
        by.setdefault(z, {})[t] = y
    for a in by:
        for b in by:
            both = [t for t in by[a] if t in by[b]]
            x, y = ([by[k][t] for t in both] for k in (a, b))
            if "z0" in (a, b):
                assert (a, b) not in got
            else:
                assert np.isclose(got[a, b], np.corrcoef(x, y)[0, 1])
    monkeypatch.setattr(MB, "MOST_ZONES", 3)
    with pytest.raises(ValueError, match="7 zones"):
        MB.cross_zone_correlation(panel)


def test_table_quantiles_match_numpy(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 50), float(rng.randrange(4)), None) for _ in range(700)] + [(None, 2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.973, "e": 1.0}
    got = table_quantiles(df, {c: (F.col(c), probs) for c in "xyz"})
    for k, c in enumerate("xy"):
        values = [r[k] for r in rows if r[k] is not None]
        assert np.allclose([got[c][n] for n in probs], np.quantile(values, list(probs.values())))
    assert set(got["z"].values()) == {None}
