"""Fitted models per fold against fits made from each fold's own rows."""

import numpy as np
import pandas as pd
import pytest

from quaymetrics.operators.forecasts import EDGES, model_forecasts

FEATURES = ["a", "b"]
MIN = 8


def sample(seed=3, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for series in ("s1", "s2", None):
        months = pd.date_range("2000-01-01", periods=n, freq="MS")
        a, b = rng.normal(5e3, 10, n), rng.normal(0, 1, n)
        y = 1e6 + 30 * a + 200 * b + rng.normal(0, 50, n)
        late = rng.integers(0, 4, n) * 40 + 20
        pdf = pd.DataFrame(
            {
                "series_id": series,
                "period": months.date,
                "origin": months + pd.Timedelta(days=31),
                "release": months + pd.Timedelta(days=31) + pd.to_timedelta(late, "D"),
                "y": y,
                "a": np.where(rng.random(n) < 0.2, np.nan, a),
                "b": np.where(np.arange(n) < 12, np.nan, b),
            }
        )
        pdf.loc[5, "y"] = np.nan
        pdf.loc[7, "release"] = pd.NaT
        out.append(pdf)
    return pd.concat(out)


def frame(spark, pdf):
    texts = pdf.assign(**{c: pdf[c].astype(str) for c in ("origin", "release")}).astype(object)
    rows = spark.createDataFrame(
        texts.where(pdf.notna(), None).values.tolist(),
        "series_id string, period date, origin string, release string, y double, a double, b double",
    )
    return rows.withColumns({c: rows[c].cast("timestamp_ntz") for c in ("origin", "release")})


def plain(pdf):
    """(series, period) -> training matrix, targets and asked row, imputed by the fold's medians."""
    out = {}
    for series, rows in pdf.groupby("series_id", dropna=False):
        rows = rows.sort_values("period").reset_index(drop=True)
        for i in range(len(rows)):
            past = rows.iloc[:i]
            known = past[(past.release <= rows.origin[i]) & past.y.notna()]
            if len(known) < MIN:
                continue
            middle = known[FEATURES].median().fillna(0.0)
            out[(None if pd.isna(series) else series, rows.period[i])] = (
                known[FEATURES].fillna(middle).to_numpy(float),
                known.y.to_numpy(float),
                rows.loc[i, FEATURES].astype(float).fillna(middle).to_numpy(float),
            )
    return out


def linear(x, y, asked, penalty=None):
    sd = x.std(axis=0)
    sd[sd == 0] = 1.0
    z, at = (x - x.mean(axis=0)) / sd, (asked - x.mean(axis=0)) / sd
    if penalty is None:
        coef = np.linalg.lstsq(z, y - y.mean(), rcond=1e-8)[0]
        return y.mean() + at @ coef
    coef, c = np.zeros(x.shape[1]), y - y.mean()
    for _ in range(3000):
        for j in range(x.shape[1]):
            own = (z[:, j] ** 2).mean()
            rho = (z[:, j] * (c - z @ coef)).mean() + own * coef[j]
            coef[j] = np.sign(rho) * max(abs(rho) - penalty / 2, 0) / (own + penalty / 2)
    return y.mean() + at @ coef


def trees(x, y, asked, rate, rounds, depth=2, leaf=3, l2=1.0):
    """Boosting on rows, with splits at the bin edges of the fold."""
    edges = [np.quantile(c, EDGES) for c in x.T]

    def grow(inside, residual, level):
        total, n = residual[inside].sum(), inside.sum()
        best = None
        for j, cuts in enumerate(edges if level < depth else []):
            for cut in cuts:
                left = inside & (x[:, j] <= cut)
                right = inside & ~left
                if min(left.sum(), right.sum()) < leaf:
                    continue
                gain = (
                    residual[left].sum() ** 2 / (left.sum() + l2)
                    + residual[right].sum() ** 2 / (right.sum() + l2)
                    - total**2 / (n + l2)
                )
                if best is None or gain > best[0] * (1 + 1e-9):
                    best = (gain, j, cut, left, right)
        if best is None or best[0] <= 1e-9 * total**2 / (n + l2):
            value = rate * total / (n + l2)
            return np.where(inside, value, 0.0), lambda q: value
        _, j, cut, left, right = best
        (a, f), (b, g) = grow(left, residual, level + 1), grow(right, residual, level + 1)
        return a + b, lambda q: f(q) if q[j] <= cut else g(q)

    fitted, out = np.full(len(y), y.mean()), y.mean()
    for _ in range(rounds):
        step, tree = grow(np.ones(len(y), bool), y - fitted, 0)
        fitted, out = fitted + step, out + tree(asked)
    return out


def got(df):
    return {(r.series_id, r.period): r for r in df.collect()}


def test_linear_models_match_fits_of_each_fold(spark):
    pdf = sample()
    want = plain(pdf)
    df = frame(spark, pdf)
    grid = {"bridge_ols": [0.0], "elastic_net": [40.0]}
    made = model_forecasts(df, FEATURES, grid, min_train=MIN).collect()
    for model, (setting,) in grid.items():
        rows = {(r.series_id, r.period): r for r in made if r.model_id == model}
        assert rows.keys() == want.keys()
        for key, (x, y, asked) in want.items():
            expected = linear(x, y, asked, setting if model == "elastic_net" else None)
            assert rows[key].prediction == pytest.approx(expected, rel=1e-7), key
            assert rows[key].n_train == len(y)
            assert rows[key].converged


def test_trees_match_boosting_on_rows(spark):
    pdf = sample()
    # bins of complete values, as a bin edge is a quantile of known values
    pdf["a"] = pdf["a"].fillna(5000.0)
    pdf["b"] = np.arange(len(pdf)) % 40 * 1.0
    want = plain(pdf)
    rows = got(
        model_forecasts(
            frame(spark, pdf), FEATURES, {"boosted_trees": [0.2]},
            min_train=MIN, trees=12, depth=2, min_leaf=3,
        )
    )
    assert rows.keys() == want.keys()
    for key, (x, y, asked) in want.items():
        assert rows[key].prediction == pytest.approx(trees(x, y, asked, 0.2, 12), rel=1e-9), key


def test_collinear_constant_and_unknown_features(spark):
    pdf = sample()
    pdf["b"] = 2 * pdf["a"]
    one = got(model_forecasts(frame(spark, pdf), ["a"], {"bridge_ols": [0.0]}, min_train=MIN))
    two = got(model_forecasts(frame(spark, pdf), FEATURES, {"bridge_ols": [0.0]}, min_train=MIN))
    pdf["b"] = np.nan
    none = got(model_forecasts(frame(spark, pdf), FEATURES, {"bridge_ols": [0.0]}, min_train=MIN))
    for key, r in one.items():
        assert two[key].prediction == pytest.approx(r.prediction, rel=1e-7)
        assert none[key].prediction == pytest.approx(r.prediction, rel=1e-7)


def test_empty_input_and_unknown_model(spark):
    empty = frame(spark, sample()).limit(0)
    grid = {"bridge_ols": [0.0], "elastic_net": [0.1], "boosted_trees": [0.1]}
    assert model_forecasts(empty, FEATURES, grid).count() == 0
    with pytest.raises(ValueError, match="unknown models"):
        model_forecasts(empty, FEATURES, {"forest": [1.0]})


def test_a_net_that_does_not_settle_says_so(spark):
    df = frame(spark, sample())
    rows = model_forecasts(df, FEATURES, {"elastic_net": [0.001]}, min_train=MIN, max_rounds=1)
    assert not any(r.converged for r in rows.collect() if r.n_train > 20)
