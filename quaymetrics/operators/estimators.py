"""Linear estimators whose data-sized work is a Spark aggregation.

One pass sums cross-products, a second sums score outer products (per cluster where asked).
Only k x k matrices reach the driver, with k the number of regressors.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import hash32, join_null_safe, ratio
from quaymetrics.session import forget, stored

# --- small numeric helpers on the driver ------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + num / (c if abs(c) > 1e-300 else 1e-300)
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided tail probability of Student's t."""
    if not math.isfinite(t) or dof <= 0:
        return float("nan") if math.isnan(t) else 0.0
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x or 1e-300)
        + b * math.log(max(1.0 - x, 1e-300))
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_critical(alpha: float, dof: float) -> float:
    """The value that |t| exceeds with probability alpha."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, dof) > alpha else (low, mid)
    return (low + high) / 2.0


def symmetric(values: Mapping[str, float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = float(values[f"c{i}_{j}"] or 0.0)
    return m


def product_columns(cols: Sequence[Column], weight: Column | None = None) -> list[Column]:
    out = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            p = a * cols[j]
            out.append(F.sum(p if weight is None else p * weight).alias(f"c{i}_{j}"))
    return out


def cross_products(
    df: DataFrame, cols: Sequence[Column], weight: Column | None = None
) -> tuple[np.ndarray, int]:
    """Sum of the outer products of a row vector, and the number of rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *product_columns(cols, weight)).first().asDict()
    return symmetric(row, len(cols)), row["n"]


def cluster_meat(
    df: DataFrame, scores: Sequence[Column], clusters: Sequence[str]
) -> tuple[np.ndarray, int]:
    """Outer products of score sums per cluster, and the number of clusters."""
    sums = df.groupBy(*clusters).agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(scores)])
    return cross_products(sums, [F.col(f"s{i}") for i in range(len(scores))])


def linear(coefs: Sequence[float], cols: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for b, c in zip(coefs, cols, strict=True):
        out = out + float(b) * c
    return out


#: A column with less than this part of its own variation left after the others depends on them.
DEPENDENT = 1e-10


def independent_columns(
    gram: np.ndarray, names: Sequence[str], sizes: Sequence[float], collinear: str = "error"
) -> list[int]:
    """Columns kept by a pivoted factorisation of their products, in order.

    `sizes` are the columns' own sums of squares before anything was taken out of them. Of
    dependent columns the later ones go: as an error, or with collinear="drop" by name.
    """
    if collinear not in ("error", "drop"):
        raise ValueError(f"unknown treatment of collinear columns {collinear!r}")
    k = len(names)
    own = np.sqrt(np.maximum(np.asarray(sizes, float), 0.0))
    scale = np.where(own > 0, own, np.inf)
    left = np.array(gram[:k, :k], float) / np.outer(scale, scale)
    kept: list[int] = []
    while len(kept) < k:
        rest = [i for i in range(k) if i not in kept]
        best = max(rest, key=lambda i: (round(left[i, i], 9), -i))
        pivot = left[best, best]
        if not pivot > DEPENDENT:
            break
        kept.append(best)
        left = left - np.outer(left[:, best], left[best]) / pivot
    lost = [names[i] for i in range(k) if i not in kept]
    if lost and collinear == "error":
        raise ValueError(f"design is rank deficient: {', '.join(lost)} depend on other columns")
    return sorted(kept)


def solved(
    gram: np.ndarray, kept: Sequence[int], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Inverse products and coefficients over the kept columns; zero elsewhere."""
    inv, beta = np.zeros((k, k)), np.zeros(k)
    at = np.ix_(kept, kept)
    scale = np.sqrt(np.diag(gram)[list(kept)])
    inv[at] = np.linalg.inv(gram[at] / np.outer(scale, scale)) / np.outer(scale, scale)
    if gram.shape[0] > k:
        beta = inv @ gram[:k, k]
    return inv, beta


def coefficient_table(
    df: DataFrame,
    names: Sequence[str],
    beta: np.ndarray,
    vcov: np.ndarray,
    dof: float,
    **facts: float | int | str | Sequence[int],
) -> DataFrame:
    """The k estimated coefficients as a DataFrame; null where a column was dropped."""
    kept = facts.pop("kept", range(len(names)))
    rows = []
    for i, name in enumerate(names):
        if i not in kept:
            rows.append((name, None, None, None, None, float(dof)))
            continue
        se = math.sqrt(max(float(vcov[i, i]), 0.0))
        t = float(beta[i]) / se if se > 0 else float("nan")
        rows.append((name, float(beta[i]), se, t, t_two_sided(t, dof), float(dof)))
    out = df.sparkSession.createDataFrame(
        rows,
        "term string, estimate double, std_error double, t_stat double, p_value double, dof double",
    )
    return out.withColumns({k: F.lit(v) for k, v in facts.items()})


# --- least squares ----------------------------------------------------------------


def _design(xs: Sequence[str], intercept: bool) -> tuple[list[str], list[Column]]:
    names = (["const"] if intercept else []) + list(xs)
    cols = ([F.lit(1.0)] if intercept else []) + [F.col(x).cast("double") for x in xs]
    return names, cols


def diff_in_means(df: DataFrame, outcome: str, treatment: str) -> DataFrame:
    """Welch difference in means of a two-level treatment, in one aggregation."""
    y, t = F.col(outcome), F.col(treatment)
    clean = df.where(y.isNotNull() & t.isNotNull())
    arms = clean.agg(
        F.avg(F.when(t == 1, y)).alias("m1"),
        F.avg(F.when(t == 0, y)).alias("m0"),
        (F.var_samp(F.when(t == 1, y)) / F.count(F.when(t == 1, y))).alias("v1"),
        (F.var_samp(F.when(t == 0, y)) / F.count(F.when(t == 0, y))).alias("v0"),
        F.count(F.when(t == 1, y)).alias("n_treated"),
        F.count(F.when(t == 0, y)).alias("n_control"),
    )
    v = F.col("v1") + F.col("v0")
    spread = F.col("v1") * F.col("v1") / (F.col("n_treated") - 1) + F.col("v0") * F.col("v0") / (
        F.col("n_control") - 1
    )
    return arms.select(
        (F.col("m1") - F.col("m0")).alias("estimate"),
        F.sqrt(v).alias("standard_error"),
        ratio(v * v, spread).alias("degrees_freedom"),
        ratio(F.col("m1") - F.col("m0"), F.sqrt(v)).alias("t_stat"),
        "n_treated",
        "n_control",
    )


def ols(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    clusters: Sequence[str] = (),
    intercept: bool = True,
    collinear: str = "error",
) -> DataFrame:
    """OLS with HC1, one-way CR1, or two-way (inclusion-exclusion) cluster errors.

    Products are of centred regressors where there is an intercept, so that a large mean does not
    look like dependence on it. Dependent regressors are an error, or dropped by name.
    """
    clean = df.dropna(subset=[y, *xs, *clusters])
    names, cols = _design(xs, intercept)
    k = len(cols)
    turn = np.eye(k)
    if intercept and xs:
        means = clean.agg(*[F.avg(F.col(x).cast("double")).alias(f"m{i}") for i, x in enumerate(xs)])
        centre = [float(m or 0.0) for m in means.first()]
        cols = [cols[0], *[c - m for c, m in zip(cols[1:], centre, strict=True)]]
        turn[0, 1:] = [-m for m in centre]
    gram, n = cross_products(clean, [*cols, F.col(y).cast("double")])
    kept = independent_columns(gram, names, np.diag(gram)[:k], collinear)
    inv, beta = solved(gram, kept, k)
    resid = F.col(y) - linear(beta, cols)
    scores = [c * resid for c in cols]
    rank = len(kept)
    facts = {"n_obs": n, "rank": rank, "kept": kept}
    if not clusters:
        meat, _ = cross_products(clean, scores)
        vcov = turn @ (inv @ meat @ inv * (n / max(n - rank, 1))) @ turn.T
        return coefficient_table(clean, names, turn @ beta, vcov, n - rank, n_clusters=n, **facts)
    vcov, smallest = np.zeros((k, k)), None
    for r in range(1, len(clusters) + 1):
        for combo in combinations(clusters, r):
            meat, g = cluster_meat(clean, scores, combo)
            if r == 1:
                smallest = g if smallest is None else min(smallest, g)
            adj = (g / max(g - 1, 1)) * ((n - 1) / max(n - rank, 1))
            vcov += (-1) ** (r + 1) * adj * (inv @ meat @ inv)
    vcov = turn @ vcov @ turn.T
    return coefficient_table(
        clean, names, turn @ beta, vcov, smallest - 1, n_clusters=smallest, **facts
    )


# --- absorbed effects -------------------------------------------------------------


def _demeaned(cells: DataFrame, prefix: str, cols: Sequence[str], effect: str) -> DataFrame:
    means = cells.groupBy(effect).agg(
        *[ratio(F.sum(F.col("_w") * F.col(f"{prefix}{c}")), F.sum("_w")).alias(f"_g_{c}") for c in cols]
    )
    return join_null_safe(cells, means, [effect]).withColumns(
        {f"{prefix}{c}": F.col(f"{prefix}{c}") - F.coalesce(f"_g_{c}", F.lit(0.0)) for c in cols}
    ).drop(*[f"_g_{c}" for c in cols])


def _swept(cells: DataFrame, source: str, out: str, cols: Sequence[str], effects: Sequence[str]) -> DataFrame:
    """`out` is `source` less its means by all effects but the first, forth and back, and by the
    first: a symmetric step on what has no means by the first effect."""
    done = cells.withColumns({f"{out}{c}": F.col(f"{source}{c}") for c in cols})
    for e in [*effects[1:], *effects[-2:0:-1], effects[0]]:
        done = _demeaned(done, out, cols, e)
    return done


def absorb(
    df: DataFrame,
    cols: Sequence[str],
    effects: Sequence[str],
    weight: str | None = None,
    tol: float = 1e-9,
    max_iter: int = 400,
    start: str | None = None,
) -> tuple[DataFrame, int, bool]:
    """Residuals of `cols` on the effects, as columns `<col>_w`, the rounds, and whether what the
    last of them still had to move is less than `tol`.

    What the effects take out depends only on the sums per combination of effects, so the
    projections run on that cell table, never on the rows, by conjugate gradients on the symmetric
    sweep over the effects. Hot effect values are averaged by partial aggregation. Each round is one
    stored table. `start` is the prefix of columns with an earlier solution for each of `cols`, any
    function of the effects, from which the search sets out.
    """
    effects = list(effects)
    w = F.lit(1.0) if weight is None else F.col(weight)
    begin = {c: F.col(c) - (F.col(f"{start}{c}") if start else F.lit(0.0)) for c in cols}
    cells = df.groupBy(*effects).agg(
        F.sum(w).alias("_w"), *[F.sum(w * begin[c]).alias(f"_s_{c}") for c in cols]
    )
    cells = cells.select(
        *effects, "_w", *[ratio(F.col(f"_s_{c}"), F.col("_w")).alias(f"_m_{c}") for c in cols]
    ).withColumns({f"_z_{c}": F.col(f"_m_{c}") for c in cols})
    rounds, converged = 1, True
    cells = _demeaned(cells, "_z_", cols, effects[0])
    if len(effects) > 1:
        cells, rounds, converged = _conjugate(cells, cols, effects, tol, max_iter)
    taken = cells.select(
        *effects, *[(F.col(f"_m_{c}") - F.col(f"_z_{c}")).alias(f"_t_{c}") for c in cols]
    )
    out = join_null_safe(df, taken, effects)
    return (
        out.withColumns({f"{c}_w": begin[c] - F.col(f"_t_{c}") for c in cols}).drop(
            *[f"_t_{c}" for c in cols]
        ),
        rounds,
        converged,
    )


def _conjugate(
    cells: DataFrame, cols: Sequence[str], effects: Sequence[str], tol: float, max_iter: int
) -> tuple[DataFrame, int, bool]:
    """Takes out of `_z_` what the sweep still moves, one direction `_p_` a round."""
    start = stored(cells, "cells")
    first = _swept(start, "_z_", "_v_", cols, effects)
    gaps = {f"_r_{c}": F.col(f"_z_{c}") - F.col(f"_v_{c}") for c in cols}
    cells = first.withColumns(gaps).withColumns({f"_p_{c}": F.col(f"_r_{c}") for c in cols})
    cells = stored(_swept(cells, "_p_", "_v_", cols, effects), "cells")
    forget(start)
    rounds = 1
    while True:
        # what the sweep moves a direction by is the direction less its sweep
        sums = []
        for c in cols:
            r, p = F.col(f"_r_{c}"), F.col(f"_p_{c}")
            moved = p - F.col(f"_v_{c}")
            sums += [
                F.sum(F.col("_w") * r * r).alias(f"rr_{c}"),
                F.sum(F.col("_w") * p * moved).alias(f"pv_{c}"),
                F.sum(F.col("_w") * r * moved).alias(f"rv_{c}"),
                F.sum(F.col("_w") * moved * moved).alias(f"vv_{c}"),
                F.max(F.abs(r)).alias(f"far_{c}"),
                F.max(F.abs(F.col(f"_m_{c}"))).alias(f"size_{c}"),
            ]
        row = cells.agg(*sums).first().asDict()
        far = {c: (row[f"far_{c}"] or 0.0) / max(row[f"size_{c}"] or 0.0, 1.0) for c in cols}
        settled = max(far.values()) < tol
        if settled or rounds >= max_iter:
            return cells, rounds, settled
        rounds += 1
        step, turn = {}, {}
        for c in cols:
            rr, pv = row[f"rr_{c}"] or 0.0, row[f"pv_{c}"] or 0.0
            # a settled column stays: what is left of it is rounding, which must not steer it
            moves = far[c] >= tol and pv > 0
            step[c] = rr / pv if moves else 0.0
            ahead = rr - 2 * step[c] * row[f"rv_{c}"] + step[c] ** 2 * row[f"vv_{c}"] if moves else 0.0
            turn[c] = ahead / rr if ahead > 0 else 0.0
        new = cells.withColumns(
            {
                **{f"_z_{c}": F.col(f"_z_{c}") - step[c] * F.col(f"_p_{c}") for c in cols},
                **{
                    f"_r_{c}": F.col(f"_r_{c}") - step[c] * (F.col(f"_p_{c}") - F.col(f"_v_{c}"))
                    for c in cols
                },
            }
        ).withColumns({f"_p_{c}": F.col(f"_r_{c}") + turn[c] * F.col(f"_p_{c}") for c in cols})
        older, cells = cells, stored(_swept(new, "_p_", "_v_", cols, effects), "cells")
        forget(older)


def effect_levels(df: DataFrame, effects: Sequence[str]) -> int:
    """Parameters of the absorbed effects; each one after the first shares the intercept."""
    row = df.agg(*[F.count_distinct(e).alias(e) for e in effects]).first()
    return sum(row) - max(len(effects) - 1, 0)


def _cluster_vcov(
    df: DataFrame, inv: np.ndarray, scores: Sequence[Column], clusters: Sequence[str]
) -> tuple[np.ndarray, int]:
    k = len(scores)
    if not clusters:
        meat, n = cross_products(df, scores)
        return inv @ meat @ inv, n
    meat, smallest = np.zeros((k, k)), None
    for r in range(1, len(clusters) + 1):
        for combo in combinations(clusters, r):
            part, g = cluster_meat(df, scores, combo)
            meat += (-1) ** (r + 1) * part
            if r == 1:
                smallest = g if smallest is None else min(smallest, g)
    return inv @ meat @ inv, smallest


def ols_hdfe(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    effects: Sequence[str],
    clusters: Sequence[str] = (),
    weight: str | None = None,
    tol: float = 1e-9,
    max_iter: int = 400,
    collinear: str = "error",
) -> DataFrame:
    """Weighted OLS with absorbed effects and cluster-robust errors.

    `converged` is false on rows whose projections stopped at `max_iter` rounds. A regressor that
    depends on the effects or on other regressors is an error, or dropped by name.
    """
    used = [y, *xs, *effects, *clusters, *([weight] if weight else [])]
    clean = df.select(*dict.fromkeys(used)).dropna()
    clean = clean.withColumns({c: F.col(c).cast("double") for c in (y, *xs)})
    within, rounds, converged = absorb(clean, [y, *xs], effects, weight, tol, max_iter)
    cols = [F.col(f"{x}_w") for x in xs]
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(xs)
    gram, n = cross_products(within, [*cols, F.col(f"{y}_w")], w)
    kept = independent_columns(gram, xs, _sizes(clean, xs, w), collinear)
    inv, beta = solved(gram, kept, k)
    resid = F.col(f"{y}_w") - linear(beta, cols)
    vcov, g = _cluster_vcov(within, inv, [c * w * resid for c in cols], clusters)
    dof = max(n - len(kept) - effect_levels(clean, effects), 1)
    vcov = vcov * (g / max(g - 1, 1)) * ((n - 1) / dof)
    return coefficient_table(
        clean,
        xs,
        beta,
        vcov,
        g - 1 if clusters else dof,
        n_obs=n,
        n_clusters=g,
        rank=len(kept),
        kept=kept,
        rounds=rounds,
        converged=converged,
    )


def _sizes(df: DataFrame, xs: Sequence[str], weight: Column) -> list[float]:
    """Weighted sums of squares of columns about their means."""
    means = [float(m or 0.0) for m in df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]).first()]
    gaps = [F.col(x) - m for x, m in zip(xs, means, strict=True)]
    # rounding leaves something of a constant column; that is not variation
    row = df.agg(*[F.sum(weight * g * g).alias(f"s{i}") for i, g in enumerate(gaps)], F.sum(weight)).first()
    floors = [(1e-12 * m) ** 2 * float(row[-1] or 0.0) for m in means]
    return [s if (s or 0.0) > f else 0.0 for s, f in zip(row[:-1], floors, strict=True)]


def ppml_hdfe(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    effects: Sequence[str],
    clusters: Sequence[str] = (),
    tol: float = 1e-9,
    max_iter: int = 200,
    collinear: str = "error",
) -> DataFrame:
    """Poisson pseudo-likelihood with absorbed effects by reweighted least squares.

    `converged` is false where the deviance still moved after `max_iter` rounds, or a projection
    of the last round or of the scores did.

    Zeros are kept. A regressor constant within zeros and within positives, with different
    values, is reported as separated. The working table is stored each round, so the
    plan does not grow and a lost executor costs one round.
    """
    keep = [y, *xs, *effects, *clusters]
    base = df.select(*dict.fromkeys(keep)).dropna()
    base = base.withColumns({c: F.col(c).cast("double") for c in (y, *xs)})
    yy = F.col(y)
    pos = yy > 0
    spread = base.agg(
        F.count_if(yy < 0).alias("negative"),
        F.count_if(~pos).alias("zeros"),
        *[
            e.alias(f"{n}_{x}")
            for x in xs
            for n, e in {
                "p0": F.min(F.when(pos, F.col(x))),
                "p1": F.max(F.when(pos, F.col(x))),
                "z0": F.min(F.when(~pos, F.col(x))),
                "z1": F.max(F.when(~pos, F.col(x))),
            }.items()
        ],
    ).first()
    if spread["negative"]:
        raise ValueError("Poisson estimation needs a non-negative outcome")
    separated = [
        x
        for x in xs
        if spread["zeros"]
        and spread[f"p0_{x}"] == spread[f"p1_{x}"]
        and spread[f"z0_{x}"] == spread[f"z1_{x}"]
        and spread[f"p0_{x}"] != spread[f"z0_{x}"]
    ]
    base = stored(base, "poisson-rows")
    hints = ["_h__z", *[f"_h_{x}" for x in xs]]
    work = base.withColumns({h: F.lit(0.0) for h in hints})
    work = work.withColumn("_mu", yy + 0.1).withColumn("_eta", F.ln("_mu"))
    k, beta, last, rounds, converged, inner_rounds = len(xs), np.zeros(len(xs)), None, 0, False, 0
    while rounds < max_iter:
        rounds += 1
        z = F.col("_eta") + (yy - F.col("_mu")) / F.col("_mu")
        # Inner projections need only be as precise as the outer step is still long, and set out
        # from what the effects took in the round before.
        inner = 1e-5 if rounds <= 2 else tol
        within, taken, inner_ok = absorb(
            work.withColumn("_z", z), ["_z", *xs], effects, "_mu", inner, start="_h_"
        )
        inner_rounds += taken
        cols = [F.col(f"{x}_w") for x in xs]
        gram, n = cross_products(within, [*cols, F.col("_z_w")], F.col("_mu"))
        if rounds == 1:
            kept = independent_columns(gram, xs, _sizes(work, xs, F.col("_mu")), collinear)
        inv, beta = solved(gram, kept, k)
        eta = F.col("_z") - (F.col("_z_w") - linear(beta, cols))
        bounded = F.least(F.greatest(eta, F.lit(-80.0)), F.lit(80.0))
        older, work = work, stored(
            within.withColumn("_eta", bounded)
            .withColumn("_mu", F.exp("_eta"))
            .withColumns({f"_h_{c}": F.col(c) - F.col(f"{c}_w") for c in ("_z", *xs)})
            .select(*base.columns, *hints, "_mu", "_eta"),
            "poisson",
        )
        forget(older)
        gap = F.when(pos, yy * F.ln(yy / F.col("_mu"))).otherwise(0.0) - (yy - F.col("_mu"))
        dev = 2.0 * work.agg(F.sum(gap)).first()[0]
        if last is not None and abs(last - dev) / (abs(dev) + 0.1) < tol:
            converged = inner_ok
            break
        last = dev
    within, taken, scores_ok = absorb(work, list(xs), effects, "_mu", tol, start="_h_")
    converged = converged and scores_ok
    cols = [F.col(f"{x}_w") for x in xs]
    gram, n = cross_products(within, cols, F.col("_mu"))
    inv, _ = solved(gram, kept, k)
    resid = yy - F.col("_mu")
    vcov, g = _cluster_vcov(within, inv, [c * resid for c in cols], clusters)
    vcov = vcov * (g / max(g - 1, 1))
    return coefficient_table(
        base,
        xs,
        beta,
        vcov,
        g - 1,
        n_obs=n,
        n_clusters=g,
        rank=len(kept),
        kept=kept,
        rounds=rounds,
        inner_rounds=inner_rounds + taken,
        converged=converged,
        n_zero=spread["zeros"],
        separated=",".join(separated),
    )


def did(
    df: DataFrame,
    y: str,
    unit: str,
    time: str,
    treatment: str,
    post: str | None = None,
    covariates: Sequence[str] = (),
) -> DataFrame:
    """Two-way fixed-effects difference in differences, unit-clustered.

    With `post`, the effect is of group membership times post; otherwise the treatment must
    itself be active only in treated periods.
    """
    active = F.col(treatment).cast("double")
    if post is not None:
        active = active * F.col(post).cast("double")
    panel = df.withColumn("did", active).withColumn("_unit", F.col(unit))
    return ols_hdfe(panel, y, ["did", *covariates], [unit, time], ["_unit"])


def did_balanced(df: DataFrame, y: str, unit: str, time: str, treated: str, post: str) -> DataFrame:
    """The same contrast from group means, exact on a balanced panel."""
    t, p, v = F.col(treated), F.col(post), F.col(y)

    def mean(a: int, b: int) -> Column:
        return F.avg(F.when((t == a) & (p == b), v))

    return df.agg(
        ((mean(1, 1) - mean(1, 0)) - (mean(0, 1) - mean(0, 0))).alias("estimate"),
        F.count_distinct(unit).alias("n_units"),
        F.count_distinct(time).alias("n_periods"),
    )


# --- wild cluster bootstrap -------------------------------------------------------


def wild_bootstrap(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    effects: Sequence[str],
    cluster: str,
    replicates: int = 999,
    salt: str = "boot",
) -> DataFrame:
    """Bootstrap-t p-value of the first regressor with the null imposed.

    `converged` is false where the absorbed effects were not settled. Rows are reduced to one set of cross-products per cluster before replicates multiply
    them, and signs are hashes of (cluster, replicate), so the result is reproducible.
    """
    clean = df.select(*dict.fromkeys([y, *xs, *effects, cluster])).dropna()
    clean = clean.withColumns({c: F.col(c).cast("double") for c in (y, *xs)})
    within, _, converged = absorb(clean, [y, *xs], effects)
    k = len(xs)
    cols = [F.col(f"{x}_w") for x in xs]
    yw = F.col(f"{y}_w")
    gram, n = cross_products(within, [*cols, yw])
    independent_columns(gram, xs, _sizes(clean, xs, F.lit(1.0)))
    inv, beta = solved(gram, range(k), k)
    restricted = np.zeros(k)
    if k > 1:
        restricted[1:] = np.linalg.solve(gram[1:k, 1:k], gram[1:k, k])
    fitted = linear(restricted, cols)
    per_cluster = within.groupBy(cluster).agg(
        *[F.sum(c * fitted).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.sum(c * (yw - fitted)).alias(f"b{i}") for i, c in enumerate(cols)],
        *[F.sum(c * (yw - linear(beta, cols))).alias(f"u{i}") for i, c in enumerate(cols)],
        *[
            F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}")
            for i in range(k)
            for j in range(k)
        ],
    )
    per_cluster = stored(per_cluster, "clusters")
    meat, g = cross_products(per_cluster, [F.col(f"u{i}") for i in range(k)])
    dof = max(n - k - effect_levels(clean, effects), 1)
    adj = (g / max(g - 1, 1)) * ((n - 1) / dof)
    se = math.sqrt(max((inv @ meat @ inv)[0, 0] * adj, 0.0))
    t_obs = beta[0] / se if se > 0 else float("nan")

    draws = per_cluster.withColumn(
        "replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    )
    sign = F.when(hash32(cluster, "replicate", salt=salt) % 2 == 0, 1.0).otherwise(-1.0)
    draws = draws.withColumn("_sign", sign)
    star = [F.col(f"a{i}") + F.col("_sign") * F.col(f"b{i}") for i in range(k)]
    moments = draws.groupBy("replicate").agg(*[F.sum(star[i]).alias(f"m{i}") for i in range(k)])
    betas = moments.select(
        "replicate",
        *[linear(inv[i], [F.col(f"m{j}") for j in range(k)]).alias(f"beta{i}") for i in range(k)],
    )
    boot_scores = [
        star[i] - linear([1.0] * k, [F.col(f"g{i}_{j}") * F.col(f"beta{j}") for j in range(k)])
        for i in range(k)
    ]
    variances = (
        draws.join(betas, "replicate")
        .groupBy("replicate")
        .agg(F.max("beta0").alias("beta0"), *product_columns(boot_scores))
    )
    var0 = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            a, b = min(i, j), max(i, j)
            var0 = var0 + float(inv[0, i] * inv[0, j]) * F.col(f"c{a}_{b}")
    small = float((g / max(g - 1, 1)) * ((n - 1) / max(n - k - 1, 1)))
    t_boot = variances.select(
        F.when(var0 > 0, F.col("beta0") / F.sqrt(var0 * small)).alias("t")
    ).where(F.col("t").isNotNull())
    return t_boot.agg(
        F.lit(xs[0]).alias("term"),
        F.lit(float(beta[0])).alias("estimate"),
        F.lit(se).alias("std_error"),
        F.lit(float(t_obs)).alias("t_observed"),
        F.lit(t_two_sided(t_obs, g - 1)).alias("analytic_p_value"),
        F.avg((F.abs("t") >= abs(float(t_obs))).cast("double")).alias("bootstrap_p_value"),
        F.lit(g).alias("n_clusters"),
        F.count(F.lit(1)).alias("n_boot"),
        F.lit(converged).alias("converged"),
    )


# --- cross-fitting ----------------------------------------------------------------


def fold_of(key: str | Sequence[str], folds: int, salt: str = "fold") -> Column:
    """Fold by a stable hash; hash a cluster id to keep clusters whole."""
    keys = [key] if isinstance(key, str) else list(key)
    return F.pmod(hash32(*keys, salt=salt), F.lit(folds))


def _fold_coefficients(
    df: DataFrame, y: str, xs: Sequence[str], fold: str, arms: Sequence[int], treatment: str
) -> dict[tuple[int, int], np.ndarray]:
    """Linear outcome models per (held-out fold, arm) from one aggregation over all folds."""
    _, cols = _design(xs, True)
    k = len(cols)
    rows = (
        df.groupBy(fold, treatment).agg(*product_columns([*cols, F.col(y).cast("double")])).collect()
    )
    grams = {(r[fold], int(r[treatment])): symmetric(r.asDict(), k + 1) for r in rows}
    folds = sorted({f for f, _ in grams})
    out = {}
    for f in folds:
        for arm in arms:
            kept = [m for (g, a), m in grams.items() if g != f and a == arm]
            if not kept:
                raise ValueError(f"no training rows of arm {arm} outside fold {f}")
            total = sum(kept)
            out[f, arm] = np.linalg.pinv(total[:k, :k]) @ total[:k, k]
    return out


def _per_fold(fold: str, values: Mapping[int, Column]) -> Column:
    out = F
    for f, c in values.items():
        out = out.when(F.col(fold) == f, c)
    return out.otherwise(F.lit(None).cast("double"))


NEWTON_ROUNDS = 100


def _propensity(
    df: DataFrame, xs: Sequence[str], treatment: str, fold: str, folds: int
) -> DataFrame:
    """Cross-fitted logistic propensity: one Newton path per fold, all folds in one pass.

    A fold whose path does not settle, as when the covariates separate the arms, is an error.
    """
    _, cols = _design(xs, True)
    k = len(cols)
    betas = {f: np.zeros(k) for f in range(folds)}
    t = F.col(treatment).cast("double")
    for _ in range(NEWTON_ROUNDS):
        aggs = []
        for f, b in betas.items():
            p = 1.0 / (1.0 + F.exp(-linear(b, cols)))
            train = F.when(F.col(fold) != f, 1.0).otherwise(0.0)
            for i in range(k):
                aggs.append(F.sum(train * cols[i] * (t - p)).alias(f"s{f}_{i}"))
                for j in range(i, k):
                    aggs.append(
                        F.sum(train * cols[i] * cols[j] * p * (1.0 - p)).alias(f"h{f}_{i}_{j}")
                    )
        row = df.agg(*aggs).first().asDict()
        longest = 0.0
        for f in betas:
            score = np.array([row[f"s{f}_{i}"] for i in range(k)], dtype=float)
            hess = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    hess[i, j] = hess[j, i] = row[f"h{f}_{i}_{j}"]
            step = np.linalg.pinv(hess) @ score
            betas[f] = betas[f] + step
            longest = max(longest, float(np.max(np.abs(step))))
        if longest < 1e-8:
            break
    else:
        raise ValueError(f"propensity not settled after {NEWTON_ROUNDS} rounds; arms separated?")
    p = {f: 1.0 / (1.0 + F.exp(-linear(b, cols))) for f, b in betas.items()}
    return df.withColumn("propensity", _per_fold(fold, p))


def aipw(
    df: DataFrame,
    y: str,
    treatment: str,
    xs: Sequence[str],
    unit: str,
    cluster: str | None = None,
    folds: int = 5,
    clip: float = 0.02,
) -> DataFrame:
    """Cross-fitted doubly robust effect with clipped propensity and clustered errors."""
    clean = df.dropna(subset=[y, treatment, *xs]).withColumn(
        "_fold", fold_of(cluster or unit, folds)
    )
    models = _fold_coefficients(clean, y, xs, "_fold", (0, 1), treatment)
    _, cols = _design(xs, True)
    ids = sorted({f for f, _ in models})
    mu = {
        a: _per_fold("_fold", {f: linear(models[f, a], cols) for f in ids}) for a in (0, 1)
    }
    scored = _propensity(clean, xs, treatment, "_fold", folds)
    e = F.least(F.greatest(F.col("propensity"), F.lit(clip)), F.lit(1.0 - clip))
    t, out = F.col(treatment), F.col(y)
    scored = scored.withColumns({"_e": e, "_m1": mu[1], "_m0": mu[0]})
    psi = (
        F.col("_m1")
        - F.col("_m0")
        + t * (out - F.col("_m1")) / F.col("_e")
        - (1 - t) * (out - F.col("_m0")) / (1 - F.col("_e"))
    )
    scored = scored.withColumn("_psi", psi)
    n_and_mean = scored.agg(F.count(F.lit(1)).alias("n"), F.avg("_psi").alias("m")).first()
    n, mean = n_and_mean["n"], n_and_mean["m"]
    group = cluster or unit
    parts = scored.groupBy(group).agg(F.sum(F.col("_psi") - mean).alias("_i"))
    return parts.agg(
        F.lit(float(mean)).alias("estimate"),
        F.sqrt(F.sum(F.col("_i") * F.col("_i")) / (float(n) * float(n))
               * ratio(F.count(F.lit(1)), F.count(F.lit(1)) - 1)).alias("standard_error"),
        F.lit(n).alias("n_obs"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.lit(folds).alias("folds"),
    )


def t_learner(
    df: DataFrame, y: str, treatment: str, xs: Sequence[str], unit: str, folds: int = 5
) -> DataFrame:
    """Cross-fitted linear models per arm; the row-level effect is their difference."""
    clean = df.dropna(subset=[y, treatment, *xs]).withColumn("_fold", fold_of(unit, folds))
    models = _fold_coefficients(clean, y, xs, "_fold", (0, 1), treatment)
    _, cols = _design(xs, True)
    effect = {
        f: linear(models[f, 1] - models[f, 0], cols) for f in sorted({f for f, _ in models})
    }
    return clean.withColumn("estimated_effect", _per_fold("_fold", effect)).drop("_fold")


def s_learner(
    df: DataFrame,
    y: str,
    treatment: str,
    xs: Sequence[str],
    unit: str,
    folds: int = 2,
    trees: int = 20,
    depth: int = 5,
    seed: int = 7,
) -> DataFrame:
    """Cross-fitted forest on (treatment, covariates); effect is the predicted contrast."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    clean = df.dropna(subset=[y, treatment, *xs]).withColumn("_fold", fold_of(unit, folds))
    clean = clean.withColumns({c: F.col(c).cast("double") for c in (y, treatment, *xs)})
    assemble = VectorAssembler(inputCols=["_t", *xs], outputCol="_features")
    forest = RandomForestRegressor(
        featuresCol="_features", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed
    )
    out = None
    for f in range(folds):
        train = clean.where(F.col("_fold") != f).withColumn("_t", F.col(treatment))
        model = forest.fit(assemble.transform(train))
        held = clean.where(F.col("_fold") == f)
        for arm in (1.0, 0.0):
            tagged = assemble.transform(held.withColumn("_t", F.lit(arm)))
            held = model.setPredictionCol(f"_y{int(arm)}").transform(tagged).drop("_features", "_t")
        part = held.withColumn("estimated_effect", F.col("_y1") - F.col("_y0"))
        part = part.drop("_y1", "_y0", "_fold")
        out = part if out is None else out.unionByName(part)
    return out


# --- synthetic control ------------------------------------------------------------


#: Donors that join the active set in one round, and the gap, as a part of the treated path's own
#: sum of squares, at which no donor can lower the objective any more.
JOINING, GAP = 8, 1e-12


def simplex_weights(
    gram: np.ndarray, cross: np.ndarray, rounds: int = 20_000
) -> tuple[np.ndarray, bool]:
    """Minimise w'Gw - 2c'w over the simplex: accelerated projected gradient, then the exact
    solution on the support that it found where that is feasible; and whether it settled."""
    k = len(cross)
    w = v = np.full(k, 1.0 / k)
    top = float(np.linalg.eigvalsh(gram)[-1])
    step, momentum, settled = 1.0 / (2.0 * top if top > 0 else 1.0), 1.0, False
    for _ in range(rounds):
        u = v - step * 2.0 * (gram @ v - cross)
        s = np.sort(u)[::-1]
        slack = (np.cumsum(s) - 1.0) / np.arange(1, k + 1)
        new = np.maximum(u - slack[np.nonzero(s - slack > 0)[0][-1]], 0.0)
        if (v - new) @ (new - w) > 0:
            momentum = 1.0
        nxt = (1.0 + math.sqrt(1.0 + 4.0 * momentum**2)) / 2.0
        v = new + (momentum - 1.0) / nxt * (new - w)
        moved = float(np.max(np.abs(new - w)))
        w, momentum = new, nxt
        settled = moved < 1e-13
        if settled:
            break
    support = np.flatnonzero(w > 1e-9)
    m = len(support)
    system = np.zeros((m + 1, m + 1))
    system[:m, :m] = 2.0 * gram[np.ix_(support, support)]
    system[:m, m] = system[m, :m] = 1.0
    exact = np.linalg.lstsq(system, np.append(2.0 * cross[support], 1.0), rcond=None)[0][:m]
    if np.all(exact >= 0) and abs(exact.sum() - 1.0) < 1e-9:
        polished = np.zeros(k)
        polished[support] = exact / exact.sum()
        value = lambda x: x @ gram @ x - 2.0 * cross @ x
        if value(polished) <= value(w):
            return polished, True
    return w, settled


def synthetic_weights(
    panel: DataFrame,
    unit: str,
    time: str,
    y: str,
    treated: str,
    first_post: str,
    max_rounds: int = 200,
) -> tuple[DataFrame, dict[str, float | int | bool]]:
    """(u, w) of the donors with weight, and the facts of the fit.

    Fully corrective conditional gradients: each round joins the residual of every pre-period to
    all donors' rows, sums each donor's gradient, and takes in the few donors that lower the
    objective most; the weights of the active donors are then solved for exactly. The optimum needs
    at most one donor per pre-period and one more, so the active paths are small however many donors
    there are. The gap bounds what any weights could still gain.
    """
    rows = panel.select(
        F.col(unit).cast("string").alias("u"), F.col(time).alias("t"), F.col(y).cast("double").alias("v")
    ).where(F.col(time) < first_post)
    span = rows.agg(F.count_distinct("t")).scalar()
    whole = rows.groupBy("u").agg(F.count("v").alias("n")).where(F.col("n") == span).select("u")
    pre = stored(rows.join(whole, "u", "left_semi"), "donors")
    mine = pre.where(F.col("u") == str(treated)).orderBy("t").collect()
    others = pre.where(F.col("u") != str(treated))
    n_donors = others.select("u").distinct().count()
    if not mine or n_donors < 2:
        raise ValueError("need the treated unit and two donors observed in all pre-periods")
    times = [r["t"] for r in mine]
    target = np.array([r["v"] for r in mine])
    scale = max(float(target @ target), 1e-300)
    active: list[str] = []
    paths = np.zeros((0, len(times)))
    weights = np.zeros(0)
    rounds, gap = 0, math.inf
    while rounds < max_rounds:
        rounds += 1
        fitted = weights @ paths if active else np.zeros(len(times))
        residual = panel.sparkSession.createDataFrame(
            [(i, float(e)) for i, e in enumerate(target - fitted)], "_k long, e double"
        )
        calendar = panel.sparkSession.createDataFrame(
            [(t, i) for i, t in enumerate(times)], f"t {pre.schema['t'].dataType.simpleString()}, _k long"
        ).join(residual, "_k")
        gradient = others.join(calendar, "t").groupBy("u").agg(
            (-2.0 * F.sum(F.col("v") * F.col("e"))).alias("g")
        )
        least = gradient.orderBy("g", "u").limit(JOINING).collect()
        if active:
            own = -2.0 * paths @ (target - fitted)
            gap = float(weights @ own - min(least[0]["g"], own.min())) / scale
            if gap < GAP:
                break
        fresh = [r["u"] for r in least if r["u"] not in active]
        if not fresh:
            break
        found = {}
        for r in others.where(F.col("u").isin(fresh)).collect():
            found.setdefault(r["u"], {})[r["t"]] = r["v"]
        active += sorted(found)
        paths = np.vstack([paths, *[[[found[u][t] for t in times]] for u in sorted(found)]])
        # weights sum to one, so distances to the target will do; the common level, next to which
        # nearly equal donors look the same, is not in them
        apart = paths - target
        weights, _ = simplex_weights(apart @ apart.T / scale, np.zeros(len(active)))
        keep = weights > 0
        active, paths, weights = [u for u, k in zip(active, keep, strict=True) if k], paths[keep], weights[keep]
    forget(pre)
    table = panel.sparkSession.createDataFrame(
        [(u, float(w)) for u, w in zip(active, weights, strict=True)], "u string, w double"
    )
    return table, {
        "n_donors": n_donors,
        "rounds": rounds,
        "optimality_gap": max(gap, 0.0),
        "converged": gap < math.sqrt(GAP),
    }


def synthetic_control(
    panel: DataFrame, unit: str, time: str, y: str, treated: str, first_post: str
) -> DataFrame:
    """Simplex-weighted donors matched on pre-period paths, and the gap in every period.

    The panel is one row per (unit, period). `optimality_gap` is the most that other weights could
    lower the pre-period sum of squares, as a part of the treated unit's own.
    """
    w, facts = synthetic_weights(panel, unit, time, y, treated, first_post)
    joined = panel.withColumn("u", F.col(unit).cast("string")).join(w, "u", "left")
    mine = F.col("u") == str(treated)
    value = F.max(F.when(mine, F.col(y)))
    synthetic = F.sum(F.when(~mine, F.coalesce("w", F.lit(0.0)) * F.col(y)))
    return joined.groupBy(time).agg(
        value.alias("treated"),
        synthetic.alias("synthetic"),
        (value - synthetic).alias("gap"),
        F.max((F.col(time) >= first_post).cast("int")).alias("post"),
        *[F.lit(v).alias(k) for k, v in facts.items()],
    )
