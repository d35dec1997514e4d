"""Forecasts of fitted models over expanding folds: bridge OLS, elastic net, boosted trees.

Spark makes each fold's statistics; what a model is fitted from no longer grows with the history.
A fold's training rows are a prefix of its series in the order in which targets become usable, so

* linear models use running sums of products of (1, y, values, missing flags); the fold's medians
  enter afterwards, as imputation is linear in values and flags;
* medians and bin edges are order statistics of growing prefixes;
* trees use counts and sums of the target by cell of binned features. Edges belong to a fold, so its
  rows are paired with it: one row per fold and earlier period, dealt by fold.

One row per series, setting and fold is then fitted, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import join_null_safe, ordered, rows_to_here
from quaymetrics.operators.evaluation import _prefix_order_statistics, usable_order
from quaymetrics.session import stored

LINEAR = ("bridge_ols", "elastic_net")
TREES = "boosted_trees"

#: Inner edges of the bins that trees split at, and the median.
EDGES = (0.2, 0.4, 0.6, 0.8)
MEDIAN = 0.5


def _finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _upper_triangle(q: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(q) for b in range(a, q)]


# --- statistics of a fold ---------------------------------------------------------


def _prefix_quantiles(
    usable: DataFrame, series: str, features: Sequence[str], points: Sequence[float], min_train: int
) -> DataFrame:
    """One row per fold: `_q`, an array per feature of its quantiles among the fold's known rows.

    A feature without a known value has nulls.
    """
    index = {f: i for i, f in enumerate(features)}
    long = usable.select(
        series,
        "_i",
        "_in",
        "_time",
        "_tie",
        F.col("_m").alias("_n"),
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f).alias("_r")) for f, i in index.items()])
        ).alias("_x"),
    ).select(series, "_i", "_in", "_time", "_tie", "_n", "_x.*")
    keys = [series, "_f"]
    known = F.when(F.col("_in") == 1, F.col("_r").isNotNull().cast("int")).otherwise(0)
    counted = stored(
        long.withColumn("_m", F.sum(known).over(rows_to_here(keys, "_time", "_tie"))), "known"
    )
    values = stored(
        counted.where((F.col("_in") == 1) & F.col("_r").isNotNull()).select(
            *keys,
            F.col("_m").alias("_s"),
            (F.row_number().over(ordered(keys, "_r", "_i")) - 1).cast("bigint").alias("_v"),
            "_r",
        ),
        "values",
    )
    looks = counted.where((F.col("_in") == 0) & (F.col("_n") >= min_train) & (F.col("_m") > 0))
    ranks = [
        F.struct(
            F.lit(f"{p}_{edge.__name__}").alias("_which"),
            (edge(p * (F.col("_m") - 1)) + 1).cast("bigint").alias("_k"),
        )
        for p in points
        for edge in (F.floor, F.ceil)
    ]
    asks = looks.select(*keys, "_i", "_m", F.explode(F.array(*ranks)).alias("_a")).select(
        *keys, "_i", "_m", "_a._which", "_a._k"
    )
    found = _prefix_order_statistics(values, asks, keys)
    found = join_null_safe(found, looks.select(*keys, "_i", "_m"), [*keys, "_i"])

    def at(f: int, p: float) -> Column:
        def one(edge: str) -> Column:
            here = (F.col("_f") == f) & (F.col("_which") == f"{p}_{edge}")
            return F.max(F.when(here, F.col("_r")))

        place = F.max(F.when(F.col("_f") == f, p * (F.col("_m") - 1)))
        return one("floor") + (one("ceil") - one("floor")) * (place - F.floor(place))

    per_feature = [F.array(*[at(i, p) for p in points]) for i in index.values()]
    return found.groupBy(series, "_i").agg(F.array(*per_feature).alias("_q"))


def _running_products(usable: DataFrame, series: str, features: Sequence[str]) -> DataFrame:
    """One row per fold: `_g`, sums of products of (1, y, values, missing flags) of its rows.

    Values are measured from their series' mean in its deviations, which no fit depends on, so
    that sums of squares do not cancel.
    """
    seen = usable.where(F.col("_in") == 0)
    aggs = []
    for i, c in enumerate(["y", *features]):
        spread = F.stddev_pop(c)
        aggs += [
            F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_c{i}"),
            F.when(spread > 0, spread).otherwise(1.0).alias(f"_s{i}"),
        ]
    units = seen.groupBy(series).agg(*aggs)
    rows = join_null_safe(usable, units, [series])
    scaled = [(F.col(c) - F.col(f"_c{i}")) / F.col(f"_s{i}") for i, c in enumerate(["y", *features])]
    flags = [F.col(f).isNull().cast("double") for f in features]
    vector = [F.lit(1.0), *[F.coalesce(z, F.lit(0.0)) for z in scaled], *flags]
    w = rows_to_here([series], "_time", "_tie")
    used = F.col("_in") == 1
    rows = rows.withColumns({f"_p{a}": e for a, e in enumerate(vector)})
    sums = [
        F.sum(F.when(used, F.col(f"_p{a}") * F.col(f"_p{b}")).otherwise(0.0)).over(w)
        for a, b in _upper_triangle(len(vector))
    ]
    return (
        rows.select(
            series,
            "_i",
            "_in",
            F.array(*sums).alias("_g"),
            F.array(*[F.col(f"_c{i}") for i in range(len(features) + 1)]).alias("_centre"),
            F.array(*[F.col(f"_s{i}") for i in range(len(features) + 1)]).alias("_unit"),
        )
        .where(F.col("_in") == 0)
        .drop("_in")
    )


def _cells(
    usable: DataFrame, quantiles: DataFrame, series: str, features: Sequence[str]
) -> DataFrame:
    """One row per fold: `_cells`, its rows counted and their targets summed by cell of bins.

    A fold has no more cells than training rows, nor than bins to the power of features.
    """
    entries = usable.where(F.col("_in") == 1)
    lasts = usable.where(F.col("_in") == 0).groupBy(series).agg(F.max("_i").alias("_last"))
    place = usable.where(F.col("_in") == 0).select(series, "_i", "_m")
    # _m of an entry is its place in the order of use; folds with at least that many rows use it
    pairs = join_null_safe(
        entries.select(series, F.col("_i").alias("_j"), F.col("_m").alias("_at"), "y", *features),
        lasts,
        [series],
    ).withColumn("_i", F.explode(F.sequence(F.col("_j") + 1, F.greatest(F.col("_last"), F.col("_j") + 1))))
    folds = join_null_safe(quantiles, place, [series, "_i"], "inner")
    pairs = join_null_safe(pairs, folds, [series, "_i"], "inner").where(F.col("_at") <= F.col("_m"))
    bins = [_bin(F.col(f), F.col("_q")[i]) for i, f in enumerate(features)]
    code = reduce(lambda a, b: a * (len(EDGES) + 1) + b, bins, F.lit(0).cast("bigint"))
    cells = pairs.groupBy(series, "_i", code.alias("_code")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_y")
    )
    cell = F.struct("_code", "_n", "_y")
    return cells.groupBy(series, "_i").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))


def _bin(x: Column, quantiles: Column) -> Column:
    """Number of edges below the value, which is the median where it is missing."""
    value = F.coalesce(x, quantiles[0], F.lit(0.0))
    above = [(value > quantiles[i + 1]).cast("int") for i in range(len(EDGES))]
    return F.coalesce(reduce(lambda a, b: a + b, above), F.lit(0))


# --- fits -------------------------------------------------------------------------


def _linear_fit(
    products: np.ndarray, medians: np.ndarray, x: np.ndarray, net: np.ndarray,
    lasso: np.ndarray, ridge: np.ndarray, max_rounds: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictions of a batch of folds from their sums of products, all in the series' units."""
    k = medians.shape[1]
    size = 2 + 2 * k
    gram = np.zeros((len(x), size, size))
    for place, (a, b) in enumerate(_upper_triangle(size)):
        gram[:, a, b] = gram[:, b, a] = products[:, place]
    impute = np.zeros((len(x), 2 + k, size))
    at = np.arange(2 + k)
    impute[:, at, at] = 1.0
    impute[:, at[2:], at[2:] + k] = medians
    gram = impute @ gram @ impute.transpose(0, 2, 1)
    n = gram[:, 0, 0]
    mean = gram[:, 0, 1:] / n[:, None]
    cov = gram[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    spread = np.einsum("bii->bi", cov)
    squares = np.einsum("bii->bi", gram[:, 1:, 1:]) / n[:, None]
    # below the rounding of its squares a column is constant
    sd = np.sqrt(np.where(spread > 1e-12 * (1.0 + squares), spread, 0.0))
    scale = np.where(sd > 0, sd, 1.0)
    corr = cov / (scale[:, :, None] * scale[:, None, :])
    corr[(sd == 0)[:, :, None] | (sd == 0)[:, None, :]] = 0.0
    r, rho = corr[:, 1:, 1:], corr[:, 1:, 0]
    z = np.where(np.isnan(x), medians, x)
    z = np.where(sd[:, 1:] > 0, (z - mean[:, 1:]) / scale[:, 1:], 0.0)
    coef = np.einsum("bij,bj->bi", np.linalg.pinv(r, rcond=1e-10, hermitian=True), rho)
    rounds = np.zeros(len(x), dtype=np.int64)
    settled = np.ones(len(x), dtype=bool)
    if net.any():
        live = np.flatnonzero(net)
        coef[live] = 0.0
        settled[live] = False
        for _ in range(max_rounds):
            c, g, t = coef[live], r[live], rho[live]
            before = c.copy()
            for j in range(k):
                own = g[:, j, j]
                slope = t[:, j] - np.einsum("bi,bi->b", g[:, j], c) + own * c[:, j]
                shrunk = np.sign(slope) * np.maximum(np.abs(slope) - lasso[live], 0.0)
                divisor = own + ridge[live]
                c[:, j] = np.where(divisor > 0, shrunk / np.where(divisor > 0, divisor, 1.0), 0.0)
            coef[live] = c
            rounds[live] += 1
            still = np.abs(c - before).max(axis=1) > 1e-9
            settled[live[~still]] = True
            live = live[still]
            if live.size == 0:
                break
    return mean[:, 0] + scale[:, 0] * (z * coef).sum(axis=1), rounds, settled


def _best_split(
    codes: np.ndarray, n: np.ndarray, total: np.ndarray, min_leaf: int, l2: float
) -> tuple[int, int] | None:
    """Feature and last left bin of the split with the greatest gain; ties: the first."""
    k = codes.shape[1]
    bins = len(EDGES) + 1
    flat = (codes + bins * np.arange(k)).ravel()
    left_n, left = (
        np.bincount(flat, np.repeat(v, k), bins * k).reshape(k, bins).cumsum(axis=1)[:, :-1]
        for v in (n, total)
    )
    whole_n, whole = n.sum(), total.sum()
    right_n, right = whole_n - left_n, whole - left
    allowed = (left_n >= min_leaf) & (right_n >= min_leaf)
    if not allowed.any():
        return None
    before = whole**2 / (whole_n + l2)
    gain = np.full(allowed.shape, -np.inf)
    gain[allowed] = (left**2)[allowed] / (left_n[allowed] + l2)
    gain[allowed] += (right**2)[allowed] / (right_n[allowed] + l2) - before
    best = int(np.argmax(gain))
    if gain.flat[best] <= 1e-9 * before + 1e-300:
        return None
    return divmod(best, bins - 1)


def _boost(
    codes: np.ndarray, n: np.ndarray, y: np.ndarray, asked: np.ndarray, rate: float,
    rounds: int, depth: int, min_leaf: int, l2: float,
) -> float:
    """Prediction for the cell `asked` by trees grown on residual sums of cells."""
    centre = y.sum() / n.sum()
    residual, out = y - n * centre, float(centre)
    for _ in range(rounds):
        step = np.zeros(len(n))
        gain = 0.0
        nodes = [(np.ones(len(n), dtype=bool), True, 0)]
        while nodes:
            inside, holds, level = nodes.pop()
            split = None
            if level < depth:
                split = _best_split(codes[inside], n[inside], residual[inside], min_leaf, l2)
            if split is None:
                value = rate * residual[inside].sum() / (n[inside].sum() + l2)
                step[inside] = value
                gain += value if holds else 0.0
                continue
            j, last = split
            left = codes[:, j] <= last
            goes_left = asked[j] <= last
            nodes += [
                (inside & left, holds and goes_left, level + 1),
                (inside & ~left, holds and not goes_left, level + 1),
            ]
        residual = residual - n * step
        out += gain
    return out


def model_forecasts(
    df: DataFrame,
    features: Sequence[str],
    grid: Mapping[str, Sequence[float]],
    series: str = "series_id",
    period: str = "period",
    min_train: int = 12,
    l1_ratio: float = 0.5,
    relative_penalty: bool = False,
    max_rounds: int = 10_000,
    trees: int = 150,
    depth: int = 3,
    min_leaf: int = 5,
    l2: float = 1.0,
) -> DataFrame:
    """Out-of-sample forecasts of each (model, setting) over expanding folds.

    `df` has one row per (series, period) with origin, release, y and the features. Only targets
    released by an origin train its fold; missing features take the fold's median, and a feature
    without any known value is zero. `grid` maps bridge_ols (setting unused), elastic_net (penalty,
    its lasso part in units of y or, with `relative_penalty`, of the fold's deviation of y) and
    boosted_trees (learning rate) to settings. Collinear features share their weight by least norm. Values that are not finite
    are missing. A fold with fewer than `min_train` known targets is left out; so is a row without
    origin. `rounds` and `converged` tell whether the elastic net settled. Origins that fall along
    a series are an error.
    """
    unknown = set(grid) - {*LINEAR, TREES}
    if unknown:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    names, k = list(features), len(features)
    columns = [f"_x{i}" for i in range(k)]
    rows = stored(
        df.select(
            F.col(series).alias("_series"),
            F.col(period).alias("_period"),
            "origin",
            "release",
            _finite(F.col("y")).alias("y"),
            *[_finite(F.col(f)).alias(c) for f, c in zip(names, columns, strict=True)],
        ).withColumn("_i", F.row_number().over(ordered(["_series"], "_period"))),
        "series",
    )
    usable = usable_order(rows, ["_series"], F.col("y").isNotNull())
    wanted = {m: [float(s) for s in v] for m, v in grid.items()}
    points = [MEDIAN, *(EDGES if TREES in wanted else ())]
    quantiles = stored(_prefix_quantiles(usable, "_series", columns, points, min_train), "quantiles")
    looks = usable.where((F.col("_in") == 0) & (F.col("_m") >= min_train))
    folds = looks.select(
        "_series", "_period", "_i", F.col("_m").cast("bigint").alias("n_train"), "y", *columns
    )
    folds = join_null_safe(folds, quantiles, ["_series", "_i"])
    # features that are unknown throughout a fold have no quantiles
    no_edges = F.array(*[F.array(*[F.lit(None).cast("double")] * len(points))] * k)
    folds = folds.withColumn("_q", F.coalesce("_q", no_edges))
    out = []

    def settings(models: Sequence[str]) -> Column:
        return F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model_id"), F.lit(s).alias("setting"))
                    for m in models
                    for s in wanted[m]
                ]
            )
        )

    linear = [m for m in LINEAR if m in wanted]
    if linear:
        sums = _running_products(usable, "_series", columns)
        known = join_null_safe(folds, sums, ["_series", "_i"]).withColumn("_s", settings(linear))
        unit = [(F.col("_centre")[i + 1], F.col("_unit")[i + 1]) for i in range(k)]
        middle = F.array(
            *[
                (F.coalesce(F.col("_q")[i][0], F.lit(0.0)) - c) / s
                for i, (c, s) in enumerate(unit)
            ]
        )
        at = F.array(
            *[(F.col(f) - c) / s for f, (c, s) in zip(columns, unit, strict=True)]
        )
        y_scale = F.col("_unit")[0]

        def fit_linear(
            batches: Iterator[tuple[pd.Series, ...]],
        ) -> Iterator[pd.DataFrame]:
            for g, m, x, penalty_of, y_unit, model in batches:
                net = model.to_numpy() == "elastic_net"
                products = np.array([*g], dtype=float)
                medians, point = (np.array([*v], dtype=float).reshape(len(g), k) for v in (m, x))
                ridge = penalty_of.to_numpy(dtype=float) * (1.0 - l1_ratio)
                lasso = penalty_of.to_numpy(dtype=float) * l1_ratio
                if not relative_penalty:  # slopes are in deviations of the fold's y
                    n, s1, s2 = products[:, 0], products[:, 1], products[:, 2 + 2 * k]
                    own = s2 / n - (s1 / n) ** 2
                    own = np.sqrt(np.where(own > 1e-12 * (1.0 + s2 / n), own, 1.0))
                    lasso = lasso / (own * y_unit.to_numpy(dtype=float))
                p, rounds, settled = _linear_fit(
                    products, medians, point, net, lasso, ridge, max_rounds
                )
                yield pd.DataFrame({"p": p, "rounds": rounds, "converged": settled})

        fit = F.pandas_udf(fit_linear, "p double, rounds bigint, converged boolean")
        fitted = known.withColumn("_f", fit("_g", middle, at, "_s.setting", y_scale, "_s.model_id"))
        prediction = F.col("_centre")[0] + y_scale * F.col("_f.p")
        out.append((fitted, prediction))
    if TREES in wanted:
        cells = _cells(usable, quantiles, "_series", columns)
        known = join_null_safe(folds, cells, ["_series", "_i"]).withColumn("_s", settings([TREES]))
        # few bytes, much work: a fixed number of tasks, which adaptive merging leaves alone
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        known = known.repartition(tasks, "_series", "_i", "_s")
        asked = F.array(*[_bin(F.col(c), F.col("_q")[i]) for i, c in enumerate(columns)])
        powers = (len(EDGES) + 1) ** np.arange(k - 1, -1, -1)

        def fit_trees(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for code, n, y, at, rate in batches:
                p = [
                    _boost(
                        np.asarray(c)[:, None] // powers % (len(EDGES) + 1),
                        np.asarray(m, dtype=float), np.asarray(t, dtype=float), np.asarray(a),
                        s, trees, depth, min_leaf, l2,
                    )
                    for c, m, t, a, s in zip(code, n, y, at, rate, strict=True)
                ]
                yield pd.DataFrame({"p": p, "rounds": trees, "converged": True}, index=range(len(p)))

        fit = F.pandas_udf(fit_trees, "p double, rounds bigint, converged boolean")
        parts = ("_cells._code", "_cells._n", "_cells._y")
        fitted = known.withColumn("_f", fit(*parts, asked, F.col("_s.setting")))
        out.append((fitted, F.col("_f.p")))
    done = [
        d.select(
            F.col("_series").alias(series),
            F.col("_period").alias(period),
            "_s.model_id",
            "_s.setting",
            "n_train",
            F.col("y").alias("actual"),
            p.alias("prediction"),
            "_f.rounds",
            "_f.converged",
        )
        for d, p in out
    ]
    return reduce(DataFrame.unionByName, done)
