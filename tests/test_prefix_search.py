"""Searches over growing prefixes: newest released places, residual bands, last updates."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymetrics.core import newest_before
from quaymetrics.operators import evaluation as EV
from quaymetrics.operators import updates as UP
from quaymetrics.operators import vintage as VT

DAY0 = dt.datetime(2000, 1, 1)


def day(k):
    return DAY0 + dt.timedelta(days=k)


@pytest.mark.parametrize("disorder", [0, 3, 400])
def test_newest_started_places(spark, disorder):
    rng = random.Random(disorder)
    starts = {("s", p): 2 * p + rng.randrange(disorder + 1) for p in range(1, 301)}
    starts |= {("u", p): 50 - p for p in range(1, 40)}
    asks = {(rng.choice("su"), rng.randrange(-1, 330), rng.randrange(0, 700)) for _ in range(400)}
    cells = spark.createDataFrame(
        [(k, p, day(t)) for (k, p), t in starts.items()], "k string, place int, start timestamp_ntz"
    )
    points = spark.createDataFrame(
        [(k, u, day(b)) for k, u, b in asks], "k string, upto int, before timestamp_ntz"
    )
    got = {(r.k, r.upto, r.before): r.found for r in newest_before(points, cells, ["k"], 3).collect()}
    for k, upto, before in asks:
        want = [p for p in range(upto, 0, -1) if starts.get((k, p), 10**6) < before][:3]
        assert upto < 1 or got[k, upto, day(before)] == want


def bands(rows, coverage, least):
    out = {}
    for i, (k, p, a, f, o, r) in enumerate(rows):
        past = [
            b[2] - b[3]
            for b in rows
            if b[0] == k and b[1] < p and None not in (b[2], b[3], b[5], o) and b[5] <= o
        ]
        q = np.quantile(past, [(1 - coverage) / 2, (1 + coverage) / 2]) if len(past) >= least else None
        out[k, p] = (len(past), *((f + q[0], f + q[1]) if q is not None and f is not None else (None, None)))
    return out


def test_residual_bands(spark):
    rng = random.Random(2)
    rows = []
    for k in ("a", None, "c"):
        for p in range(90):
            actual = None if rng.random() < 0.1 else rng.choice([float(rng.randrange(5)), rng.gauss(0, 9)])
            origin = None if rng.random() < 0.05 else day(10 * (p - p % 3))
            release = None if rng.random() < 0.05 else day(10 * p + rng.randrange(-30, 90))
            rows.append((k, p, actual, 1.5, origin, release))
    schema = "k string, period int, actual double, prediction double, origin timestamp_ntz, release timestamp_ntz"
    out = EV.residual_intervals(spark.createDataFrame(rows, schema), ["k"], coverage=0.7, min_residuals=4)
    want = bands(rows, 0.7, 4)
    assert out.count() == len(rows)
    for r in out.collect():
        n, low, high = want[r.k, r.period]
        assert r.n_residuals == n
        assert (r.lower is None) == (low is None)
        if low is not None:
            assert np.allclose([r.lower, r.upper], [low, high])
    with pytest.raises(ValueError, match="origins fall"):
        EV.residual_intervals(spark.createDataFrame(rows[:2] + [("a", 99, 1.0, 1.0, day(-5), day(1))], schema), ["k"])


def test_residual_bands_of_a_very_long_path(spark):
    n = 100_000
    rng = np.random.default_rng(0)
    values = rng.normal(size=n)
    df = spark.createDataFrame(
        [(i, float(v)) for i, v in enumerate(values)], "period int, actual double"
    ).select(
        F.lit("one").alias("k"),
        "period",
        "actual",
        F.lit(0.0).alias("prediction"),
        F.expr("timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, 0, period)").alias("origin"),
        F.expr("timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, 0, period + 5)").alias("release"),
    )
    out = EV.residual_intervals(df, ["k"])
    picked = out.where(F.col("period").isin(14, 15, 1000, 54_321, n - 1)).collect()
    assert len(picked) == 5
    for r in picked:
        past = values[: max(0, r.period - 4)]
        assert r.n_residuals == len(past)
        assert np.allclose([r.lower, r.upper], np.quantile(past, [0.05, 0.95]))


def test_last_update_follows_unchanged_cells(spark):
    """A level that stays the same for many periods was last changed when it began."""
    rows = [("s", dt.date(2000 + k // 12, k % 12 + 1, 1), dt.date(2000 + k // 12, k % 12 + 1, 20), 1.0 if k else 5.0) for k in range(60)]
    rows.append(("s", dt.date(2000, 3, 1), dt.date(2004, 6, 25), 9.0))
    vintages = spark.createDataFrame(
        [(s, d, a, a, v) for s, d, a, v in rows],
        "series_id string, observation_date date, realtime_start date, availability_date date, value double",
    )
    targets = spark.createDataFrame(
        [("x", dt.date(2004, 9, 1), "monthly", dt.datetime(2004, 9, 20)), ("y", dt.date(2000, 1, 1), "monthly", dt.datetime(2000, 1, 25))],
        "forecast_id string, target_period date, target_frequency string, release_timestamp timestamp_ntz",
    )
    specs = [VT.FeatureSpec("level", "s", "monthly", "level", "latest", 1)]
    got = UP.last_update(vintages, targets, specs).collect()
    assert [tuple(r) for r in got] == [
        ("x", "level", dt.datetime(2000, 2, 20, 23, 59, 59, 999999), 5.0, 1.0)
    ]
