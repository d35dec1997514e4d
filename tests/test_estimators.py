"""Estimators against plain numpy: rank, absorbed effects, Poisson, simplex weights, ladder."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaymetrics.operators import estimators as E
from quaymetrics.operators import experiments as X


def frame(spark, seed=0, n=400, units=15, times=9):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame(
        {
            "u": rng.integers(0, units, n),
            "t": rng.integers(0, times, n),
            "x": rng.normal(size=n),
            "z": rng.normal(size=n),
        }
    )
    df["x"] += 0.3 * df.u - 0.2 * df.t
    df["y"] = 1.5 * df.x - df.z + df.u + 0.5 * df.t + rng.normal(size=n)
    df["count"] = rng.poisson(np.exp(0.3 * df.x - 0.2 * df.z + 0.1 * df.u - 1))
    return spark.createDataFrame(df), df


def dummies(df, effects):
    out = [np.ones(len(df))]
    for e in effects:
        out += [(df[e] == v).to_numpy(float) for v in sorted(df[e].unique())[1:]]
    return np.stack(out, axis=1)


def terms(fit):
    return {r.term: r for r in fit.collect()}


def test_dependent_columns_are_named(spark):
    sdf, _ = frame(spark)
    sdf = sdf.withColumns({"twice": 2 * F.col("x"), "big": F.col("x") + 1e7, "five": F.lit(5.0)})
    with pytest.raises(ValueError, match="rank deficient: twice"):
        E.ols(sdf, "y", ["x", "twice"])
    with pytest.raises(ValueError, match="five"):
        E.ols(sdf, "y", ["x", "five"], ["u"])
    with pytest.raises(ValueError, match="rank deficient"):
        E.ols_hdfe(sdf, "y", ["x", "twice"], ["u"])
    with pytest.raises(ValueError, match="five"):
        E.ols_hdfe(sdf, "y", ["x", "five"], ["u", "t"])
    with pytest.raises(ValueError, match="rank deficient"):
        E.ppml_hdfe(sdf, "count", ["x", "twice"], ["u"])
    kept = terms(E.ols(sdf, "y", ["x", "twice", "z"], collinear="drop"))
    alone = terms(E.ols(sdf, "y", ["x", "z"]))
    assert kept["twice"].estimate is None and kept["x"]["rank"] == 3
    assert np.isclose(kept["x"].estimate, alone["x"].estimate)
    # a large mean is not dependence on the intercept
    shifted = terms(E.ols(sdf, "y", ["big", "z"]))
    assert np.isclose(shifted["big"].estimate, alone["x"].estimate)
    assert np.isclose(shifted["const"].estimate, alone["const"].estimate - 1e7 * alone["x"].estimate)


def test_two_absorbed_effects_equal_dummies(spark):
    sdf, df = frame(spark)
    fit = terms(E.ols_hdfe(sdf, "y", ["x", "z"], ["u", "t"]))
    design = np.column_stack([df[["x", "z"]], dummies(df, ["u", "t"])])
    beta = np.linalg.lstsq(design, df.y, rcond=None)[0]
    assert np.allclose([fit["x"].estimate, fit["z"].estimate], beta[:2], atol=1e-8)
    assert fit["x"].converged and fit["x"]["rank"] == 2


def sweeps(df, effects, tol):
    """Rounds that plain alternating means need."""
    r = df.y.to_numpy().copy()
    for k in range(1, 500):
        before = r.copy()
        for e in effects:
            r = r - pd.Series(r).groupby(df[e].to_numpy()).transform("mean").to_numpy()
        if np.abs(r - before).max() < tol * np.abs(df.y).max():
            return k
    return 500


def test_conjugate_rounds_are_fewer(spark):
    """Effects that hang together by few links are slow for alternating means."""
    rng = np.random.default_rng(1)
    rows = [(u, t) for u in range(30) for t in (u, u + 1)]
    df = pd.DataFrame(rows, columns=["u", "t"])
    df["x"] = rng.normal(size=len(df))
    df["y"] = rng.normal(size=len(df)) + df.u
    sdf = spark.createDataFrame(pd.concat([df, df.assign(x=df.x + 1, y=df.y * 0.5)]))
    within, rounds, converged = E.absorb(sdf, ["y"], ["u", "t"])
    assert converged and rounds * 2 <= sweeps(pd.concat([df, df.assign(x=df.x + 1, y=df.y * 0.5)]), ["u", "t"], 1e-9)
    fit = terms(E.ols_hdfe(sdf, "y", ["x"], ["u", "t"]))
    both = pd.concat([df, df.assign(x=df.x + 1, y=df.y * 0.5)])
    design = np.column_stack([both.x, dummies(both, ["u", "t"])])
    beta = np.linalg.lstsq(design, both.y, rcond=None)[0]
    assert np.isclose(fit["x"].estimate, beta[0], atol=1e-7)


def test_poisson_equals_dummies(spark):
    sdf, df = frame(spark, 3)
    fit = terms(E.ppml_hdfe(sdf, "count", ["x", "z"], ["u", "t"], ["u"]))
    design = np.column_stack([df[["x", "z"]], dummies(df, ["u", "t"])])
    beta = np.zeros(design.shape[1])
    beta[2] = np.log(df["count"].mean())
    for _ in range(60):
        mu = np.exp(design @ beta)
        beta = beta + np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (df["count"] - mu))
    assert np.allclose([fit["x"].estimate, fit["z"].estimate], beta[:2], atol=1e-6)
    assert fit["x"].converged


def test_synthetic_weights_are_optimal(spark):
    rng = np.random.default_rng(4)
    donors, times = 3000, 12
    paths = rng.normal(size=(donors, times)).cumsum(axis=1) + 5
    target = 0.5 * paths[7] + 0.3 * paths[41] + 0.2 * paths[2999]
    target[9:] += 4
    every = np.vstack([target, paths])
    rows = [(f"d{i - 1}" if i else "it", t, float(v)) for i, p in enumerate(every) for t, v in enumerate(p)]
    panel = spark.createDataFrame(rows, "u string, t int, y double").repartition(4)
    w, facts = E.synthetic_weights(panel, "u", "t", "y", "it", 9)
    weights = {r.u: r.w for r in w.collect()}
    assert facts["n_donors"] == donors and facts["converged"]
    assert np.isclose(sum(weights.values()), 1) and min(weights.values()) >= 0
    residual = target[:9] - sum(v * paths[int(u[1:])][:9] for u, v in weights.items())
    gradient = -2 * paths[:, :9] @ residual
    own = sum(v * gradient[int(u[1:])] for u, v in weights.items())
    assert own - gradient.min() <= 1e-6 * (target[:9] @ target[:9])
    with pytest.raises(ValueError, match="two donors"):
        E.synthetic_control(panel.where("u in ('it', 'd1')"), "u", "t", "y", "it", 9)


def exposed(spark, same=False):
    rng = np.random.default_rng(6)
    rows = []
    for z in range(12):
        for p in range(40):
            t, nb, h = rng.random(3)
            nb = t if same else nb
            rows.append((z, p, float(t), float(nb), float(h), float(4 + 2 * t + 1.5 * nb + 0.7 * h + 0.03 * rng.normal()), f"m{z % 1}"))
    return spark.createDataFrame(
        rows, "zone int, period int, treatment double, neighbor_exposure double, history_exposure double, outcome double, exposure_mapping_id string"
    ).withColumn("randomization_cluster", F.col("zone"))


def test_exposure_response_and_its_guards(spark):
    df = exposed(spark)
    fit = terms(X.exposure_response(df))
    assert np.allclose([fit[t].estimate for t in ("treatment", "neighbor_exposure", "history_exposure")], [2, 1.5, 0.7], atol=0.05)
    assert all(r.inference_valid and r.ci_low < r.estimate < r.ci_high for r in fit.values())
    assert fit["neighbor_exposure"].target_estimand == "spillover_effect"
    with pytest.raises(ValueError, match="rank deficient"):
        X.exposure_response(exposed(spark, same=True), exposures=("treatment", "neighbor_exposure"))
    with pytest.raises(ValueError, match="history_exposure"):
        X.exposure_response(df.drop("history_exposure"))
    with pytest.raises(ValueError, match="one exposure mapping"):
        X.exposure_response(df.withColumn("exposure_mapping_id", F.col("zone") % 2))
    with pytest.raises(ValueError, match="finite"):
        X.exposure_response(df.withColumn("treatment", F.lit(float("inf"))))
    with pytest.raises(ValueError, match="two clusters"):
        X.exposure_response(df.withColumn("randomization_cluster", F.lit(1)))


def test_ladder_records_why_a_method_does_not_apply(spark):
    sdf, df = frame(spark)
    data = sdf.withColumns({"d": (F.col("x") > 0).cast("int"), "one": F.lit(1.0)})
    table = X.estimate_ladder(
        data,
        {
            "diff_in_means": lambda d: E.diff_in_means(d, "y", "d"),
            "ols": lambda d: E.ols(d, "y", ["d", "z"], ["u"]).where("term = 'd'"),
            "constant": lambda d: E.ols(d, "y", ["one"]),
            "synthetic": lambda d: E.synthetic_control(d, "u", "t", "y", "nobody", 5).select(F.col("gap").alias("estimate")),
        },
    )
    rows = {r.method: r for r in table.collect()}
    assert rows["ols"].status == "ok" and rows["ols"].ci_low < rows["ols"].estimate < rows["ols"].ci_high
    assert rows["diff_in_means"].n_obs == len(df)
    assert rows["constant"].status == "not_applicable" and "rank deficient" in rows["constant"].reason
    assert rows["synthetic"].status == "not_applicable" and rows["synthetic"].estimate is None
    with pytest.raises(ValueError):
        X.estimate_ladder(data, {"constant": lambda d: E.ols(d, "y", ["one"])}, on_error="raise")


def test_nearly_equal_donors_settle_in_few_rounds(spark):
    rng = np.random.default_rng(8)
    paths = 250 + rng.normal(0, 0.5, (20, 12))
    paths[0] = 0.7 * paths[8] + 0.3 * paths[11]
    rows = [(u, t, float(paths[u, t])) for u in range(20) for t in range(12)]
    panel = spark.createDataFrame(rows, "u int, t int, y double")
    out = E.synthetic_control(panel, "u", "t", "y", "0", 12).first()
    assert out["converged"] and out["rounds"] < 8
    assert abs(out["gap"]) < 1e-6
