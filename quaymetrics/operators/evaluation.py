"""Forecast evaluation: folds, baselines, model fits, metrics, intervals and tests.

Every table here has one row per series, model and period, so windows over a series are
bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quaymetrics.core import (
    asof_backward,
    join_null_safe,
    ordered,
    ratio,
    require_none,
    rows_before,
    rows_to_here,
)
from quaymetrics.operators.estimators import t_two_sided
from quaymetrics.session import stored

# --- expanding folds --------------------------------------------------------------


def _indexed(df: DataFrame, series: str, period: str) -> DataFrame:
    return df.withColumn("_idx", F.row_number().over(ordered([series], period)) - 1)


def _late_pairs(rows: DataFrame, series: str, gap: int) -> DataFrame:
    """(row j, fold i) with j before the fold's training end but released after its origin.

    Origins do not decrease along a series, so the folds a row is late for are a run of
    indices; its end is found by an as-of merge, and only late pairs are ever produced.
    """
    marks = rows.select(series, F.col("origin").alias("_o"), F.col("_idx").alias("_last"))
    marks = marks.groupBy(series, "_o").agg(F.max("_last").alias("_last"))
    moment = F.expr("interval 0.000001 seconds")
    asked = rows.withColumn(
        "_before", F.coalesce(F.col("release") - moment, F.lit("9999-01-01").cast("timestamp_ntz"))
    )
    found = asof_backward(asked, marks, "_before", "_o", ["_last"], [series])
    first = F.col("_idx") + gap + 1
    return found.where(F.col("_last") >= first).select(
        series,
        F.col("_idx").alias("_j"),
        "y",
        "x",
        F.explode(F.sequence(first, F.col("_last"))).alias("_fold_idx"),
    )


def folds(
    df: DataFrame,
    series: str = "series_id",
    period: str = "period",
    min_train: int = 12,
    step: int = 1,
    gap: int = 0,
) -> DataFrame:
    """Expanding-window folds with sums over their training rows.

    `df` has one row per (series, period) with origin, release, y and an optional regressor x.
    A fold trains on earlier rows whose target was released by its origin. Sums over earlier
    rows come from a running window and the few late rows are subtracted, so no fold is joined
    with its history.
    """
    full = df if "x" in df.columns else df.withColumn("x", F.lit(None).cast("double"))
    rows = _indexed(full, series, period)
    y, x = F.col("y"), F.col("x")
    both = x.isNotNull() & y.isNotNull()
    parts = {
        "n_train": F.lit(1),
        "n_known": y.isNotNull().cast("int"),
        "sum_y": F.coalesce(y, F.lit(0.0)),
        "pair_n": both.cast("int"),
        "pair_x": F.when(both, x).otherwise(0.0),
        "pair_y": F.when(both, y).otherwise(0.0),
        "pair_xx": F.when(both, x * x).otherwise(0.0),
        "pair_xy": F.when(both, x * y).otherwise(0.0),
    }
    here = rows.withColumns({f"_v_{n}": e for n, e in parts.items()})
    frame = ordered([series], "_idx").rowsBetween(Window.unboundedPreceding, -(gap + 1))
    cum = here.withColumns(
        {f"_c_{n}": F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0)) for n in parts}
    ).drop(*[f"_v_{n}" for n in parts])
    late = _late_pairs(rows, series, gap)
    late_sums = (
        late.withColumns({f"_v_{n}": e for n, e in parts.items()})
        .groupBy(series, F.col("_fold_idx").alias("_idx"))
        .agg(
            *[F.sum(f"_v_{n}").alias(f"_l_{n}") for n in parts],
            F.collect_list("_j").alias("_late"),
        )
    )
    joined = cum.join(late_sums, [series, "_idx"], "left").withColumns(
        {n: F.col(f"_c_{n}") - F.coalesce(f"_l_{n}", F.lit(0)) for n in parts}
    )
    late_ids = F.coalesce("_late", F.array().cast("array<int>"))
    top = F.col("_idx") - gap - 1
    window = F.sequence(F.greatest(top - F.size(late_ids), F.lit(0)), F.greatest(top, F.lit(0)))
    kept = joined.where(
        (F.col("_idx") >= min_train + gap)
        & ((F.col("_idx") - (min_train + gap)) % step == 0)
        & (F.col("n_train") >= min_train)
    )
    return (
        kept.withColumns(
            {
                "fold": F.row_number().over(ordered([series], "_idx")) - 1,
                "n_excluded": (top + 1 - F.col("n_train")).cast("bigint"),
                "last_train_idx": F.array_max(F.array_except(window, late_ids)),
                "row_index": F.col("_idx"),
            }
        )
        .drop("_idx", "_late", *[f"_c_{n}" for n in parts], *[f"_l_{n}" for n in parts])
    )


def baseline_forecasts(
    df: DataFrame,
    series: str = "series_id",
    period: str = "period",
    min_train: int = 12,
    step: int = 1,
    gap: int = 0,
) -> DataFrame:
    """Historical mean, no-change and AR(1) forecast of every fold, in long form.

    The regressor x is the lag known at the origin. A constant lag gives a zero slope.
    """
    f = folds(df, series, period, min_train, step, gap)
    values = _indexed(df, series, period).select(
        series, F.col("_idx").alias("last_train_idx"), F.col("y").alias("_last_y")
    )
    f = f.join(values, [series, "last_train_idx"], "left")
    n = F.col("pair_n")
    sxx = F.col("pair_xx") - F.col("pair_x") * F.col("pair_x") / n
    sxy = F.col("pair_xy") - F.col("pair_x") * F.col("pair_y") / n
    slope = F.when(sxx > 1e-9, sxy / sxx).otherwise(0.0)
    ar1 = F.when(n >= 2, F.col("pair_y") / n + slope * (F.col("x") - F.col("pair_x") / n))
    models = F.explode(
        F.array(
            F.struct(
                F.lit("historical_mean").alias("m"),
                ratio(F.col("sum_y"), F.col("n_known")).alias("p"),
            ),
            F.struct(F.lit("no_change").alias("m"), F.col("_last_y").alias("p")),
            F.struct(F.lit("ar1").alias("m"), ar1.alias("p")),
        )
    )
    return f.withColumn("_f", models).select(
        series,
        period,
        "fold",
        "n_train",
        F.col("_f.m").alias("model_id"),
        F.col("y").alias("actual"),
        F.col("_f.p").alias("prediction"),
    )


# --- tuning ------------------------------------------------------------------------


def tune(
    preds: DataFrame, group: Sequence[str], candidate: Sequence[str], block: str = "evaluation_block"
) -> DataFrame:
    """Candidate with the least validation error per group, frozen, and its final error."""
    err = F.col("prediction") - F.col("actual")
    valid = F.col(block) == "tuning_validation"
    final = F.col(block) == "final_evaluation"
    scores = preds.groupBy(*group, *candidate).agg(
        F.sqrt(F.avg(F.when(valid, err * err))).alias("validation_rmse"),
        F.sqrt(F.avg(F.when(final, err * err))).alias("final_rmse"),
        F.count(F.when(valid, 1)).alias("n_validation"),
        F.count(F.when(final, 1)).alias("n_final"),
    ).where(F.col("validation_rmse").isNotNull())
    row = F.struct(*candidate, "validation_rmse", "final_rmse", "n_validation", "n_final")
    best = F.min_by(row, F.struct("validation_rmse", *candidate))
    return scores.groupBy(*group).agg(best.alias("_b")).select(*group, "_b.*")


# --- metrics ----------------------------------------------------------------------


def metrics(preds: DataFrame, by: Sequence[str], reference: str | None = None) -> DataFrame:
    """Error, bias, direction and interval scores per group.

    Direction compares the sign of the change from the reference (zero without one).
    """
    a, p = F.col("actual"), F.col("prediction")
    ref = F.col(reference) if reference else F.lit(0.0)
    err = p - a
    ok = preds.where(a.isNotNull() & p.isNotNull())
    exprs = [
        F.count(F.lit(1)).alias("n_obs"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err).alias("bias"),
        F.avg((F.signum(a - ref) == F.signum(p - ref)).cast("double")).alias(
            "directional_accuracy"
        ),
    ]
    if "lower" in preds.columns:
        lo, hi = F.col("lower"), F.col("upper")
        known = lo.isNotNull() & hi.isNotNull()
        exprs += [
            F.count(F.when(known, 1)).alias("n_intervals"),
            F.avg(F.when(known, a.between(lo, hi).cast("double"))).alias("interval_coverage"),
            F.avg(F.when(known, hi - lo)).alias("mean_interval_width"),
        ]
    return ok.groupBy(*by).agg(*exprs)


#: Parts a range of values is cut into at each level of the search for an order statistic.
PARTS = 8


def _prefix_order_statistics(
    values: DataFrame, asks: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """For each ask, the value with rank `_k` (from 1) among the first `_m` values of its path.

    `values` has (keys, _s, _v, _r): place in time, place in size from 0, and the value; `asks` has
    (keys, _i, _which, _m, _k). The range of sizes is cut into PARTS at each level; running counts in
    time order tell which part holds the rank. Every value and ask is one row at every level.
    """
    most = values.agg(F.max("_v")).first()[0] or 0
    levels = 1
    while PARTS**levels <= most:
        levels += 1
    node = asks.withColumn("_node", F.lit(0).cast("bigint"))
    for level in range(levels - 1, -1, -1):
        here = values.select(
            *keys,
            F.expr(f"_v div {PARTS ** (level + 1)}").alias("_node"),
            F.expr(f"cast(_v div {PARTS**level} % {PARTS} as int)").alias("_part"),
            F.col("_s").alias("_m"),
        )
        both = node.unionByName(here, allowMissingColumns=True)
        w = rows_to_here([*keys, "_node"], "_m", F.col("_part").isNull())
        # running counts of the parts up to each; the last one is the node's own count
        counts = F.array(*[F.count(F.when(F.col("_part") <= c, 1)).over(w) for c in range(PARTS)])
        placed = both.withColumn("_counts", counts).where(F.col("_part").isNull())
        before = F.size(F.filter("_counts", lambda c: c < F.col("_k")))
        placed = placed.withColumn("_before", before)
        below = F.when(F.col("_before") > 0, F.element_at("_counts", F.col("_before"))).otherwise(0)
        node = placed.select(
            *keys,
            "_i",
            "_which",
            "_m",
            (F.col("_k") - below).alias("_k"),
            (F.col("_node") * PARTS + F.col("_before")).alias("_node"),
        )
    return join_null_safe(
        node.withColumnRenamed("_node", "_v"), values.select(*keys, "_v", "_r"), [*keys, "_v"], "inner"
    ).select(*keys, "_i", "_which", "_r")


def usable_order(rows: DataFrame, keys: Sequence[str], known: Column) -> DataFrame:
    """Rows of each path in the order in which they become usable, merged with the origins.

    `rows` has place `_i` in its path, origin and release. A row comes twice: as `_in` = 1 at the
    time from which it is usable, which is its release or the next origin, and as `_in` = 0 at its own
    origin. `_m` counts the usable rows up to each. Origins must not fall along a path; then what an
    origin may use is a prefix of this order.
    """
    origin = F.col("origin").cast("timestamp_ntz")
    seen = F.max(origin).over(rows_before(keys, "_i"))
    require_none(rows.select((origin < seen).alias("_falls")), F.col("_falls"), "origins fall")
    release = F.col("release").cast("timestamp_ntz")
    following = F.last(origin, ignorenulls=True).over(rows_before(keys, F.desc("_i")))
    timed = rows.withColumns({"_origin": origin, "_release": release, "_following": following})
    usable = known & F.col("_release").isNotNull() & F.col("_following").isNotNull()
    times = ["_origin", "_release", "_following"]
    entries = timed.where(usable).withColumns(
        {
            "_time": F.greatest("_release", "_following"),
            "_tie": 2 * F.col("_i") + 1,
            "_in": F.lit(1),
        }
    )
    looks = timed.where(F.col("_origin").isNotNull()).withColumns(
        {"_time": F.col("_origin"), "_tie": 2 * F.col("_i"), "_in": F.lit(0)}
    )
    both = entries.unionByName(looks).drop(*times)
    return stored(
        both.withColumn("_m", F.sum("_in").over(rows_to_here(keys, "_time", "_tie"))), "usable"
    )


def residual_intervals(
    preds: DataFrame,
    keys: Sequence[str],
    period: str = "period",
    coverage: float = 0.9,
    min_residuals: int = 10,
) -> DataFrame:
    """Bands from earlier residuals whose targets were released by the forecast's origin.

    Origins must not fall along a path; then a forecast's history is all residuals up to a place in
    the order in which they became usable, and a band needs order statistics of such prefixes. No
    history is gathered. Too short a history gives no band.
    """
    keys = list(keys)
    rows = stored(preds.withColumn("_i", F.row_number().over(ordered(keys, period))), "paths")
    residual = (F.col("actual") - F.col("prediction")).cast("double").alias("_r")
    ordered_ = usable_order(rows.select(*keys, "_i", "origin", "release", residual), keys, F.col("_r").isNotNull())
    values = ordered_.where(F.col("_in") == 1).select(
        *keys,
        F.col("_m").alias("_s"),
        (F.row_number().over(ordered(keys, "_r", "_i")) - 1).cast("bigint").alias("_v"),
        "_r",
    )
    sizes = ordered_.where(F.col("_in") == 0).select(*keys, "_i", F.col("_m").alias("n_residuals"))
    tail = (1.0 - coverage) / 2.0
    n = F.col("n_residuals")
    at = {"lower": tail * (n - 1), "upper": (1.0 - tail) * (n - 1)}
    ranks = [
        F.struct(F.lit(f"{name}_{edge.__name__}").alias("_which"), (edge(x) + 1).cast("bigint").alias("_k"))
        for name, x in at.items()
        for edge in (F.floor, F.ceil)
    ]
    asks = (
        sizes.where(F.col("n_residuals") >= min_residuals)
        .select(*keys, "_i", "n_residuals", F.explode(F.array(*ranks)).alias("_a"))
        .select(*keys, "_i", n.alias("_m"), "_a._which", "_a._k")
    )
    found = _prefix_order_statistics(stored(values, "values"), asks, keys)
    wide = found.groupBy(*keys, "_i").agg(
        *[
            F.max(F.when(F.col("_which") == f"{name}_{edge}", F.col("_r"))).alias(f"_{name}_{edge}")
            for name in at
            for edge in ("floor", "ceil")
        ]
    )
    out = join_null_safe(rows, sizes, [*keys, "_i"])
    out = join_null_safe(out, wide, [*keys, "_i"])
    m = F.coalesce("n_residuals", F.lit(0)).cast("bigint")

    def edge_of(name: str, q: float) -> Column:
        x = q * (m - 1)
        low, high = F.col(f"_{name}_floor"), F.col(f"_{name}_ceil")
        return F.col("prediction") + low + (high - low) * (x - F.floor(x))

    return out.select(
        *preds.columns,
        m.alias("n_residuals"),
        edge_of("lower", tail).alias("lower"),
        edge_of("upper", 1.0 - tail).alias("upper"),
    )


@F.pandas_udf(T.DoubleType())
def _t_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(s) or pd.isna(d) else t_two_sided(float(s), float(d))
            for s, d in zip(stat, dof, strict=True)
        ]
    )


def diebold_mariano(
    preds: DataFrame,
    baseline: str,
    keys: Sequence[str],
    period: str = "period",
    horizon: int = 1,
    min_obs: int = 20,
) -> DataFrame:
    """Equal-accuracy test of each model against a baseline with a Bartlett long-run variance.

    Positive statistics favour the baseline. Short or degenerate samples carry a reason and
    no statistic.
    """
    base = preds.where(F.col("model_id") == baseline).select(
        *keys, period, F.col("prediction").alias("_base")
    )
    a = F.col("actual")
    one, two = a - F.col("prediction"), a - F.col("_base")
    d = (
        preds.where(F.col("model_id") != baseline)
        .join(base, [*keys, period])
        .withColumn("_d", one * one - two * two)
        .where(F.col("_d").isNotNull())
    )
    path = [*keys, "model_id"]
    means = d.groupBy(*path).agg(F.avg("_d").alias("_m"))
    c = join_null_safe(d, means, path).withColumn("_c", F.col("_d") - F.col("_m"))
    w = ordered(path, period)
    lags = list(range(1, horizon))
    c = c.withColumns({f"_c{k}": F.lag("_c", k).over(w) for k in lags})
    n = F.count(F.lit(1)).cast("double")
    var = F.sum(F.col("_c") * F.col("_c")) / n
    for k in lags:
        weight = 2.0 * (1.0 - k / float(horizon))
        var = var + weight * F.coalesce(F.sum(F.col("_c") * F.col(f"_c{k}")), F.lit(0.0)) / n
    rows = c.groupBy(*path).agg(
        F.count(F.lit(1)).alias("n_obs"), F.max("_m").alias("_mean"), var.alias("_var")
    )
    h, m = float(horizon), F.col("n_obs").cast("double")
    short = F.col("n_obs") < max(min_obs, horizon + 2)
    flat = F.col("_var") <= 2.220446049250313e-16
    correction = (m + 1.0 - 2.0 * h + h * (h - 1.0) / m) / m
    valid = ~short & ~flat & (correction > 0)
    stat = F.col("_mean") / F.sqrt(F.col("_var") / m) * F.sqrt(correction)
    reason = (
        F.when(short, "insufficient_observations")
        .when(flat, "degenerate_loss_differential_variance")
        .when(correction <= 0, "invalid_small_sample_correction")
    )
    out = rows.select(
        *path,
        "n_obs",
        F.when(~short, F.col("_mean")).alias("mean_loss_differential"),
        F.when(valid, stat).alias("statistic"),
        valid.alias("valid"),
        reason.alias("reason"),
    )
    return out.withColumn("p_value", _t_tail(F.col("statistic"), F.col("n_obs") - 1.0))


def stability(
    preds: DataFrame, mode: str, first: str, second: str, keys: Sequence[str], period: str
) -> DataFrame:
    """How forecasts and model ranks move between two information modes."""
    path = [*keys, "model_id"]
    a = preds.where(F.col(mode) == first).select(
        *path, period, F.col("prediction").alias("_a"), "actual"
    )
    b = preds.where(F.col(mode) == second).select(*path, period, F.col("prediction").alias("_b"))
    both = a.join(b, [*path, period])
    ea, eb = F.col("_a") - F.col("actual"), F.col("_b") - F.col("actual")
    facts = both.groupBy(*path).agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.corr("_a", "_b").alias("prediction_correlation"),
        F.avg(F.abs(F.col("_b") - F.col("_a"))).alias("mean_absolute_change"),
        F.sqrt(F.avg(ea * ea)).alias("rmse_first"),
        F.sqrt(F.avg(eb * eb)).alias("rmse_second"),
    )
    ranked = facts.withColumns(
        {
            "rank_first": F.dense_rank().over(ordered(keys, "rmse_first")),
            "rank_second": F.dense_rank().over(ordered(keys, "rmse_second")),
        }
    )
    return ranked.withColumn("rank_change", F.col("rank_second") - F.col("rank_first"))
