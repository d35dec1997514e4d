"""Assignment designs, allocation scores, Monte Carlo summaries and event-study designs.

Randomisation is by stable hash, so an assignment can be recomputed on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymetrics.core import hash32, hash_rank, join_null_safe, quantiles, ratio, share, total
from quaymetrics.operators import estimators as E
from quaymetrics.session import stored

# --- assignment -------------------------------------------------------------------


def treated_count(n: Column, p: float) -> Column:
    """Rounded share of n, leaving at least one unit in each arm."""
    return F.least(F.greatest(F.bround(n * p), F.lit(1)), n - 1)


def _complete(units: DataFrame, key: Sequence[str], p: float, salt: str) -> DataFrame:
    """Complete randomisation of distinct units, by exact rank of a salted hash.

    A single unit falls back to a coin with the configured probability.
    """
    n = F.col("_n")
    ranked = hash_rank(units, [], hash32(*key, salt=salt), list(key), "_rank").withColumn(
        "_n", total(units, F.count(F.lit(1)))
    )
    coin = (hash32(*key, salt=salt) < int(p * 2**32)).cast("int")
    arm = F.when(n == 1, coin).otherwise((F.col("_rank") <= treated_count(n, p)).cast("int"))
    prob = F.when(n == 1, F.lit(p)).otherwise(ratio(treated_count(n, p), n))
    return ranked.withColumns(
        {"assigned_treatment": arm, "treatment_probability": prob}
    ).drop("_rank", "_n")


def assign_individual(units: DataFrame, key: str, p: float, salt: str = "") -> DataFrame:
    return _complete(units, [key], p, salt)


#: Units of an aggregated cell that are drawn in one go.
BLOCK = 1 << 14


def assign_individual_shares(
    cells: DataFrame, key: str, count: str, p: float, salt: str = ""
) -> DataFrame:
    """Aggregated cells: each of a cell's units is drawn on its own; the cell gets the share.

    Units are counted off in blocks that are dealt to tasks, so a cell may have any number of them.
    """
    n = F.col(count).cast("bigint")
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / BLOCK)))
    blocks = cells.where(n > 0).select(key, n.alias("_n"), block.alias("_b")).repartition(key, "_b")
    unit = F.explode(
        F.sequence(F.col("_b") * BLOCK + 1, F.least(F.col("_n"), (F.col("_b") + 1) * BLOCK))
    )
    draws = blocks.select(key, unit.alias("_u")).withColumn(
        "_t", hash32(key, "_u", salt=salt) < int(p * 2**32)
    )
    sums = draws.groupBy(key).agg(F.count_if("_t").alias("treated_units"))
    return cells.join(sums, key, "left").withColumns(
        {
            "treated_units": F.coalesce("treated_units", F.lit(0)),
            "assigned_treatment": ratio(F.coalesce("treated_units", F.lit(0)), F.col(count)),
        }
    )


def zone_clusters(df: DataFrame, size: int | None = None, n_clusters: int | None = None) -> DataFrame:
    """Clusters of neighbouring zone codes. Ranks run over the zone dimension, not the rows."""
    zones = df.select("zone_id").distinct()
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("zone_id")) - 1
    ranked = zones.withColumn("_r", rank)
    if n_clusters is not None:
        cluster = F.floor(F.col("_r") * n_clusters / total(zones, F.count(F.lit(1))))
    else:
        cluster = F.floor(F.col("_r") / size)
    return df.join(ranked.select("zone_id", cluster.cast("int").alias("cluster_id")), "zone_id")


def time_blocks(df: DataFrame, block: int) -> DataFrame:
    """Equal blocks of consecutive observed periods (a calendar)."""
    rank = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("period_id")) - 1
    periods = df.select("period_id").distinct().withColumn(
        "time_block", F.floor(rank / block).cast("int")
    )
    return df.join(periods, "period_id")


def _assign_by(df: DataFrame, key: Sequence[str], p: float, salt: str) -> DataFrame:
    units = stored(df.select(*key).distinct(), "units")  # ranked and counted without `df`
    arms = _complete(units, key, p, salt)
    return df.join(arms, list(key))


def assign_geo(df: DataFrame, size: int, p: float, salt: str = "geo") -> DataFrame:
    """One arm per geographic cluster, held over all periods."""
    return _assign_by(zone_clusters(df, size), ["cluster_id"], p, salt)


def assign_time(df: DataFrame, block: int, p: float, salt: str = "time") -> DataFrame:
    """One arm per market-wide block of periods."""
    return _assign_by(time_blocks(df, block), ["time_block"], p, salt)


def assign_switchback(df: DataFrame, block: int, p: float, salt: str = "switch") -> DataFrame:
    """Alternating blocks; the first arm of each pair is drawn."""
    blocks = time_blocks(df, block).withColumn(
        "switchback_pair", F.floor(F.col("time_block") / 2).cast("int")
    )
    first = (hash32("switchback_pair", salt=salt) < int(p * 2**32)).cast("int")
    within = F.col("time_block") % 2
    return blocks.withColumns(
        {
            "assigned_treatment": (first + within) % 2,
            "treatment_probability": F.when(within == 0, p).otherwise(1.0 - p),
        }
    )


def assign_geo_time(
    df: DataFrame, size: int, block: int, p: float, salt: str = "cell"
) -> DataFrame:
    """One arm per geographic cluster and time block."""
    cells = time_blocks(zone_clusters(df, size), block)
    return _assign_by(cells, ["cluster_id", "time_block"], p, salt)


def balanced_counts(n: int, probabilities: Sequence[float]) -> list[int]:
    """Arm sizes by largest remainder, every arm present."""
    raw = [p * n for p in probabilities]
    counts = [max(int(r), 1) for r in raw]
    while sum(counts) > n:
        over = [i for i, c in enumerate(counts) if c > 1]
        if not over:
            raise ValueError("not enough clusters to represent every arm")
        counts[max(over, key=lambda i: counts[i] - raw[i])] -= 1
    while sum(counts) < n:
        counts[max(range(len(raw)), key=lambda i: raw[i] - counts[i])] += 1
    return counts


def assign_saturation(
    df: DataFrame,
    n_clusters: int,
    levels: Sequence[float],
    individuals: int,
    salt: str = "sat",
) -> DataFrame:
    """Two stages: clusters to saturation levels in balanced counts, then units in each cell."""
    counts = balanced_counts(n_clusters, [1.0 / len(levels)] * len(levels))
    cells = zone_clusters(df, n_clusters=n_clusters)
    clusters = hash_rank(
        cells.select("cluster_id").distinct(), [], hash32("cluster_id", salt=salt), ["cluster_id"], "_k"
    )
    bounds = [sum(counts[: i + 1]) for i in range(len(counts))]
    level = reduce(
        lambda acc, i: acc.when(F.col("_k") <= bounds[i], F.lit(float(levels[i]))),
        range(len(levels)),
        F,
    )
    prob = reduce(
        lambda acc, i: acc.when(F.col("_k") <= bounds[i], F.lit(counts[i] / n_clusters)),
        range(len(levels)),
        F,
    )
    arms = clusters.select(
        "cluster_id",
        level.alias("cluster_saturation"),
        prob.alias("saturation_assignment_probability"),
    )
    out = cells.join(arms, "cluster_id")
    drawn = F.size(
        F.filter(
            F.sequence(F.lit(1), F.lit(individuals)),
            lambda u: hash32("zone_id", "period_id", u, salt=salt)
            < F.col("cluster_saturation") * float(2**32),
        )
    )
    return out.withColumn("treated_units", drawn).withColumn(
        "assigned_treatment", F.col("treated_units") / float(individuals)
    )


def enforce_budget(
    df: DataFrame, treatment: str, cost: str | float, budget: float | None
) -> DataFrame:
    """Scale every exposure by one factor so that expected spend meets the budget."""
    unit_cost = F.lit(float(cost)) if isinstance(cost, (int, float)) else F.col(cost)
    planned = F.col(treatment).cast("double")
    gross = total(df, F.sum(planned * unit_cost))
    scale = (
        F.lit(1.0)
        if budget is None
        else F.when(gross <= budget, 1.0).otherwise(F.lit(float(budget)) / gross)
    )
    return df.withColumns({"planned_treatment": planned, "budget_scale": scale}).withColumns(
        {
            "treatment_intensity": F.col("planned_treatment") * F.col("budget_scale"),
            "expected_treatment_cost": F.col("planned_treatment")
            * F.col("budget_scale")
            * unit_cost,
        }
    )


# --- scoring ----------------------------------------------------------------------


def score_allocations(df: DataFrame, budget: float) -> DataFrame:
    """Value, spend, efficiency and selected share of each policy."""
    a = F.col("allocation").cast("double")
    spent, gain = F.sum(a * F.col("cost")), F.sum(a * F.col("effect"))
    return df.groupBy("policy").agg(
        gain.alias("expected_incremental_outcome"),
        spent.alias("budget_spent"),
        F.lit(float(budget)).alias("budget"),
        F.when(spent > 0, gain / spent).otherwise(0.0).alias("budget_efficiency"),
        F.sum(a).alias("selected_equivalent_units"),
        F.avg(a).alias("selected_share"),
        F.count(F.lit(1)).alias("holdout_rows"),
    )


def subgroup_summary(df: DataFrame, modifier: str, effect: str, bins: int = 4) -> DataFrame:
    """Effect by quantile bins of a modifier; equal values always share a bin."""
    known = df.where(F.col(modifier).isNotNull())
    cuts = quantiles(known, [], modifier, {f"q{i}": i / bins for i in range(bins + 1)}).first()
    edges = sorted({cuts[f"q{i}"] for i in range(bins + 1)})
    inner = edges[1:-1]
    out = F
    for i, e in enumerate(inner):
        out = out.when(F.col(modifier) <= F.lit(e), F.lit(i))
    label = out.otherwise(F.lit(len(inner))) if inner else F.lit(0)
    return known.groupBy(label.alias("modifier_bin")).agg(
        F.min(modifier).alias("modifier_min"),
        F.max(modifier).alias("modifier_max"),
        F.avg(effect).alias("mean_estimated_effect"),
        F.stddev_samp(effect).alias("sd_estimated_effect"),
        F.count(F.lit(1)).alias("rows"),
    )


def _jeffreys_sd(successes: Column, trials: Column) -> Column:
    a, b = successes + 0.5, trials - successes + 0.5
    n = a + b
    return F.sqrt(a * b / (n * n * (n + 1.0)))


def summarize_monte_carlo(
    records: DataFrame, groups: Sequence[str], confidence: float = 0.95
) -> DataFrame:
    """Bias, RMSE, coverage and power with their Monte Carlo errors, per design and estimator."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2.0)
    est, se, truth = F.col("estimate"), F.col("std_error"), F.col("truth")
    err = est - truth
    covered = (est - z * se <= truth) & (truth <= est + z * se)
    reject = F.coalesce(F.abs(ratio(est, se)) > z, F.lit(False))
    n = F.count(F.lit(1)).cast("double")
    mse = F.avg(err * err)
    rmse = F.sqrt(mse)
    return records.groupBy(*groups).agg(
        F.avg(truth).alias("truth"),
        F.avg(est).alias("mean_estimate"),
        F.avg(err).alias("bias"),
        (F.stddev_samp(err) / F.sqrt(n)).alias("bias_mcse"),
        F.var_samp(est).alias("variance"),
        rmse.alias("rmse"),
        F.when(rmse > 0, F.stddev_samp(err * err) / F.sqrt(n) / (2.0 * rmse))
        .otherwise(0.0)
        .alias("rmse_mcse"),
        share(covered).alias("coverage"),
        _jeffreys_sd(F.count_if(covered).cast("double"), n).alias("coverage_mcse"),
        share(reject).alias("power"),
        _jeffreys_sd(F.count_if(reject).cast("double"), n).alias("power_mcse"),
        F.avg(se).alias("mean_std_error"),
        F.count(F.lit(1)).alias("replications"),
        mse.alias("information_cost"),
    )


def best_design(summary: DataFrame, group: Sequence[str]) -> DataFrame:
    """Least RMSE per group, ties by cost and names."""
    row = F.struct("design", "estimator", "rmse", "information_cost")
    order = F.struct("rmse", "information_cost", "design", "estimator")
    return summary.groupBy(*group).agg(F.min_by(row, order).alias("_b")).select(*group, "_b.*")


def minimax(
    summary: DataFrame, scenario: str, nominal: float = 0.95, slack: float = 0.10
) -> DataFrame:
    """The pair with the least worst-scenario score among complete, valid pairs.

    The score is RMSE with a penalty for departure from nominal coverage. A pair must cover
    every scenario, be identified with valid inference and complete fits, and come within the
    slack of nominal coverage after two Monte Carlo errors.
    """
    gap = F.abs(F.col("coverage") - nominal)
    score = F.col("rmse") * (1.0 + 2.0 * gap)
    passes = F.col("coverage") + 2.0 * F.col("coverage_mcse") >= nominal - slack
    flags = [c for c in ("identified", "inference_valid", "fit_complete") if c in summary.columns]
    ok = reduce(lambda a, b: a & b, [F.col(c) for c in flags], passes)
    scenarios = total(summary, F.count_distinct(scenario))
    scored = summary.withColumns({"coverage_gap": gap, "decision_score": score, "_ok": ok})
    worst = scored.groupBy("design", "estimator").agg(
        F.bool_and("_ok").alias("_ok"),
        F.count_distinct(scenario).alias("n_scenarios"),
        F.max_by(F.struct("decision_score", "coverage_gap", "power"), "decision_score").alias("_w"),
    )
    eligible = worst.where(F.col("_ok") & (F.col("n_scenarios") == scenarios)).select(
        "design", "estimator", "n_scenarios", "_w.*"
    )
    return eligible.orderBy(
        "decision_score", "coverage_gap", F.desc("power"), "design", "estimator"
    ).limit(1)


def fit_ledger(
    plans: DataFrame, records: DataFrame, keys: Sequence[str], attempted: int
) -> DataFrame:
    """Planned fits against recorded ones; a plan without records stays, with zero successes."""
    done = records.groupBy(*keys).agg(
        F.count_if(F.col("fit_status") == "ok").alias("successful_fits"),
        F.avg(F.col("inference_valid").cast("double")).alias("inference_valid_rate"),
    )
    out = plans.join(done, list(keys), "left").withColumns(
        {
            "attempted_fits": F.lit(attempted).cast("bigint"),
            "successful_fits": F.coalesce("successful_fits", F.lit(0)),
            "inference_valid_rate": F.coalesce("inference_valid_rate", F.lit(0.0)),
        }
    )
    failed = F.col("attempted_fits") - F.col("successful_fits")
    return out.withColumns(
        {
            "failed_fits": failed,
            "fit_complete": failed == 0,
            "fit_success_rate": ratio(F.col("successful_fits"), F.col("attempted_fits")),
            "decision_eligible": F.col("identified")
            & (failed == 0)
            & (F.col("inference_valid_rate") == 1.0),
        }
    )


# --- event-study designs ----------------------------------------------------------


def event_dummies(
    df: DataFrame,
    window: tuple[int, int] = (-12, 12),
    reference: int = -1,
    event: str = "event_time",
    treated: str = "is_treated_country",
) -> tuple[DataFrame, list[str]]:
    """Treatment by event-time indicators; times outside the window go to endpoint bins."""
    lo, hi = window
    et = F.col(event)
    binned = F.when(et < lo, lo - 1).when(et > hi, hi + 1).otherwise(et)
    names, exprs = [], {}
    for k in range(lo - 1, hi + 2):
        if k == reference:
            continue
        if k == lo - 1:
            name = f"evt_pre_bin_{abs(k)}"
        elif k == hi + 1:
            name = f"evt_post_bin_{k}"
        else:
            name = f"evt_{'m' if k < 0 else 'p'}{abs(k)}"
        names.append(name)
        exprs[name] = (F.coalesce(binned == k, F.lit(False)) & F.col(treated)).cast("double")
    return df.withColumns(exprs), names


def event_study(
    df: DataFrame,
    outcome: str,
    effects: Sequence[str],
    clusters: Sequence[str],
    window: tuple[int, int] = (-12, 12),
    reference: int = -1,
    treated: str = "is_treated_country",
    estimator: str = "ols",
) -> DataFrame:
    """Dynamic effects by event time with absorbed effects; the reference row is zero.

    An event time without observations, or one the effects take up, has a null estimate.
    """
    if estimator not in ("ols", "ppml"):
        raise ValueError(f"unknown estimator {estimator!r}")
    data, names = event_dummies(df, window, reference, treated=treated)
    fit = E.ppml_hdfe if estimator == "ppml" else E.ols_hdfe
    return fit(data, outcome, names, effects, clusters, collinear="drop")


def exposure_event_study(
    df: DataFrame,
    outcome: str,
    exposure: str,
    unit: str,
    time: str,
    reference: int,
    trend_controls: Sequence[str] = (),
) -> DataFrame:
    """Period interactions of a continuous exposure, with trends in fixed characteristics."""
    stats = df.groupBy(unit).agg(F.avg(exposure).alias("e")).agg(
        F.avg("e").alias("m"), F.stddev_pop("e").alias("s")
    ).first()
    times = [r[0] for r in df.select(time).distinct().orderBy(time).collect()]
    z = (F.col(exposure) - float(stats["m"])) / float(stats["s"] or 1.0)
    cols, names = {}, []
    for t in times:
        if t == reference:
            continue
        names.append(f"exposure_at_{t}")
        cols[names[-1]] = F.when(F.col(time) == t, z).otherwise(0.0)
        for c in trend_controls:
            names.append(f"{c}_at_{t}")
            cols[names[-1]] = F.when(F.col(time) == t, F.col(c).cast("double")).otherwise(0.0)
    data = df.withColumns(cols).withColumn("_unit", F.col(unit))
    return E.ols_hdfe(data, outcome, names, [unit, time], ["_unit"], collinear="drop")


def event_means(
    df: DataFrame, outcome: str, window: tuple[int, int] = (-12, 12), treated: str = "is_treated_country"
) -> DataFrame:
    """Raw means by event time and treatment status."""
    inside = F.col("event_time").between(*window) & F.col(outcome).isNotNull()
    rows, keys = df.where(inside), ["event_time", treated]
    means = rows.groupBy(*keys).agg(
        F.avg(outcome).alias("mean"),
        F.stddev_samp(outcome).alias("sd"),
        F.count(F.lit(1)).alias("n_obs"),
    )
    return join_null_safe(means, quantiles(rows, keys, outcome, {"median": 0.5}), keys)


def stack_cohorts(
    df: DataFrame,
    cohorts: Mapping[str, int],
    window: tuple[int, int],
    control: str = "never_treated_products",
    cohort: str = "treatment_cohort",
    never: str = "NEVER_TREATED",
) -> DataFrame:
    """One sub-experiment per treatment wave; each row is repeated for the waves it serves.

    The waves are a literal array filtered per row, so no cohort table is joined. A later wave
    is a control only if it starts after the sub-experiment's window ends.
    """
    kinds = (
        "never_treated_products",
        "never_treated_products_treated_country_only",
        "not_yet_treated",
    )
    if control not in kinds:
        raise ValueError(f"unknown control definition {control!r}")
    lo, hi = window
    month = F.col("month_index")
    waves = F.array(
        *[
            F.struct(F.lit(g).alias("g"), F.lit(int(m)).alias("m"))
            for g, m in sorted(cohorts.items())
        ]
    )
    own = F.col(cohort)
    start = reduce(lambda acc, g: acc.when(own == g, F.lit(int(cohorts[g]))), sorted(cohorts), F)
    start = start.otherwise(F.lit(None).cast("int"))

    def serves(w: Column) -> Column:
        inside = month.between(w["m"] + lo, w["m"] + hi)
        member = (own == w["g"]) | (own == never)
        if control == "not_yet_treated":
            member = member | F.coalesce(start > w["m"] + hi, F.lit(False))
        return inside & member

    base = df
    if control == "never_treated_products_treated_country_only":
        base = df.where("is_treated_country")
    stacked = base.withColumn("_w", F.explode(F.filter(waves, serves)))
    return stacked.withColumns(
        {
            "stack_id": F.col("_w.g"),
            "stack_treatment_month": F.col("_w.m"),
            "event_time": month - F.col("_w.m"),
            "stack_treated": (own == F.col("_w.g")) & F.col("is_treated_country"),
            "stack_flow": F.concat_ws("@", "flow_id", F.col("_w.g")),
            "stack_month": F.concat_ws("@", "month_key", F.col("_w.g")),
        }
    ).drop("_w")


def stack_composition(stacked: DataFrame) -> DataFrame:
    """What each wave carries in a stacked design."""
    return stacked.groupBy("stack_id").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if("stack_treated").alias("n_treated_obs"),
        F.count_distinct("hs10").alias("n_products"),
        F.min("stack_treatment_month").alias("treatment_month_index"),
    )


def stacked_event_study(
    df: DataFrame,
    outcome: str,
    cohorts: Mapping[str, int],
    clusters: Sequence[str],
    window: tuple[int, int] = (-12, 10),
    reference: int = -3,
    control: str = "never_treated_products",
    estimator: str = "ols",
) -> tuple[DataFrame, DataFrame]:
    """(coefficients, composition): event times pooled over waves, each wave with its own flow and
    month effects, and what each wave carries.

    The effects are crossed with the waves, so that one absorption serves all of them. A wave's
    event month 0 falls in a calendar month of its own, so event time is not calendar time here.
    """
    stacked = stored(stack_cohorts(df, cohorts, window, control), "stacks")
    coefficients = event_study(
        stacked,
        outcome,
        ["stack_flow", "stack_month"],
        clusters,
        window,
        reference,
        treated="stack_treated",
        estimator=estimator,
    )
    return coefficients, stack_composition(stacked)


def pass_through(
    panel: DataFrame,
    outcome: str,
    channels: Sequence[str],
    post: Column,
    unit: str,
    time: str,
    replicates: int = 999,
) -> DataFrame:
    """Effect of each exposure channel after a date, one by one and all channels jointly.

    Unit and time effects are absorbed, errors are clustered by unit, and as units are often few a
    wild bootstrap stands beside the analytic test of each single channel. `model` is the channel's
    own name or `joint`.
    """
    terms = {c: f"{c}_x_post" for c in channels}
    data = panel.withColumns({t: F.col(c) * post.cast("double") for c, t in terms.items()})
    data = stored(data.withColumns({"_unit": F.col(unit)}), "channels")
    out = []
    for c, term in terms.items():
        own = data.dropna(subset=[outcome, term])
        fit = E.ols_hdfe(own, outcome, [term], [unit, time], ["_unit"])
        boot = E.wild_bootstrap(own, outcome, [term], [unit, time], "_unit", replicates)
        out.append(
            fit.join(boot.select("term", "bootstrap_p_value", "n_boot"), "term").withColumn("model", F.lit(c))
        )
    if len(channels) > 1:
        both = data.dropna(subset=[outcome, *terms.values()])
        fit = E.ols_hdfe(both, outcome, list(terms.values()), [unit, time], ["_unit"])
        out.append(fit.withColumn("model", F.lit("joint")))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    names = F.create_map(*[x for c, t in terms.items() for x in (F.lit(t), F.lit(c))])
    return with_interval(table.withColumn("channel", names[F.col("term")]))


def with_interval(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds ci_low and ci_high from each row's own degrees of freedom."""
    dofs = {r[0] for r in table.select("dof").distinct().collect()}
    half = F.lit(None).cast("double")
    for d in dofs:
        half = F.when(F.col("dof") == d, E.t_critical(alpha, d) * F.col("std_error")).otherwise(half)
    return table.withColumns({"ci_low": F.col("estimate") - half, "ci_high": F.col("estimate") + half})


# What each exposure slope is an estimate of.
EXPOSURE_TARGETS = {
    "treatment": "controlled_zone_direct_effect",
    "neighbor_exposure": "spillover_effect",
    "history_exposure": "controlled_history_exposure_response",
}


def exposure_response(
    df: DataFrame,
    outcome: str = "outcome",
    cluster: str = "randomization_cluster",
    exposures: Sequence[str] = ("treatment", "neighbor_exposure", "history_exposure"),
    covariates: Sequence[str] = (),
    minimum_clusters: int = 10,
    alpha: float = 0.05,
) -> DataFrame:
    """Own, neighbour and history exposure slopes, estimated jointly with clustered errors.

    The slopes are per unit of exposure; they are not the effect of treating the whole market. Each
    of these is an error: a missing column, an exposure or outcome that is not finite, rows of more
    than one exposure mapping, fewer than two clusters, and exposures that depend on each other.
    """
    used = [outcome, cluster, *exposures, *covariates]
    missing = sorted(set(used) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns for the exposure response: {', '.join(missing)}")
    clean = df.dropna(subset=used)
    numbers = [F.col(c).cast("double") for c in (outcome, *exposures, *covariates)]
    infinite = [F.isnan(c) | (F.abs(c) == float("inf")) for c in numbers]
    facts = clean.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(cluster).alias("clusters"),
        F.count_if(reduce(lambda a, b: a | b, infinite)).alias("infinite"),
        *(
            [F.count_distinct("exposure_mapping_id").alias("mappings")]
            if "exposure_mapping_id" in df.columns
            else [F.lit(0).alias("mappings")]
        ),
    ).first()
    if not facts["n"]:
        raise ValueError("no row has all of outcome, cluster and exposures")
    if facts["infinite"]:
        raise ValueError(f"outcome and exposures must be finite: {facts['infinite']} row(s)")
    if facts["mappings"] > 1:
        raise ValueError(f"one exposure mapping is needed, found {facts['mappings']}")
    if facts["clusters"] < 2:
        raise ValueError("clustered errors need two clusters")
    fit = E.ols(clean, outcome, [*exposures, *covariates], [cluster])
    targets = F.create_map(*[F.lit(x) for pair in EXPOSURE_TARGETS.items() for x in pair])
    rows = fit.where(F.col("term").isin(list(exposures))).withColumns(
        {
            "target_estimand": targets[F.col("term")],
            "inference_valid": F.col("n_clusters") >= minimum_clusters,
        }
    )
    return with_interval(rows, alpha)


def estimate_ladder(
    df: DataFrame,
    rungs: Mapping[str, Callable[[DataFrame], DataFrame]],
    on_error: str = "record",
) -> DataFrame:
    """Each method's estimate as one comparable row, or the reason why it does not apply.

    A rung takes the data and returns a table with `estimate` and, where it has one, `standard_error`
    (or `std_error`) and `n_obs`; its first row counts. An input that a method refuses (ValueError)
    gives a row with status not_applicable, or with on_error="raise" stays an error.
    """
    if on_error not in ("record", "raise"):
        raise ValueError(f"unknown on_error {on_error!r}")
    rows = []
    for name, rung in rungs.items():
        try:
            found = rung(df).first()
            if found is None or found["estimate"] is None:
                raise ValueError("no estimate")
            facts = found.asDict()
            se = facts.get("standard_error", facts.get("std_error"))
            dof = facts.get("degrees_freedom", facts.get("dof"))
            n = facts.get("n_obs") or (facts.get("n_treated", 0) + facts.get("n_control", 0)) or None
            estimate = float(facts["estimate"])
            half = None if not se else float(se) * (E.t_critical(0.05, dof) if dof else 1.959963984540054)
            low, high = (None, None) if half is None else (estimate - half, estimate + half)
            rows.append((name, "ok", estimate, None if se is None else float(se), low, high, n, None))
        except ValueError as reason:
            if on_error == "raise":
                raise
            rows.append((name, "not_applicable", None, None, None, None, 0, str(reason)))
    return df.sparkSession.createDataFrame(
        rows,
        "method string, status string, estimate double, standard_error double, ci_low double, "
        "ci_high double, n_obs long, reason string",
    )


# --- grids of cells ---------------------------------------------------------------


def grouped_did(
    df: DataFrame, cell: Sequence[str], y: str, treated: str, post: str, cluster: str
) -> DataFrame:
    """Two-by-two contrast of every cell at once, with clustered errors.

    Means of the four groups give the estimate; each row's influence on it is summed by
    cluster and squared.
    """
    quad = [*cell, treated, post]
    clean = df.where(F.col(y).isNotNull())
    means = clean.groupBy(*quad).agg(F.avg(y).alias("_m"), F.count(F.lit(1)).alias("_n"))
    sign = F.when(F.col(treated) == F.col(post), 1.0).otherwise(-1.0)
    estimate = means.groupBy(*cell).agg(
        F.sum(sign * F.col("_m")).alias("estimate"),
        F.count(F.lit(1)).alias("_groups"),
        F.sum("_n").alias("n_obs"),
    )
    influence = clean.join(means, quad).withColumn(
        "_i", sign * (F.col(y) - F.col("_m")) / F.col("_n")
    )
    parts = influence.groupBy(*cell, cluster).agg(F.sum("_i").alias("_i"))
    g = F.count(F.lit(1)).cast("double")
    spread = parts.groupBy(*cell).agg(
        F.sqrt(F.sum(F.col("_i") * F.col("_i")) * ratio(g, g - 1)).alias("std_error"),
        F.count(F.lit(1)).alias("n_clusters"),
    )
    return estimate.where("_groups = 4").drop("_groups").join(spread, list(cell))


def verdicts(cells: DataFrame, baseline: str, z: float = 1.6448536269514722) -> DataFrame:
    """Label each cell of a robustness grid against the baseline cell."""
    base = cells.where(F.col("cell") == baseline).select("estimate").scalar()
    b, se = F.col("estimate"), F.col("std_error")
    label = (
        F.when(b.isNull() | se.isNull() | (se <= 0), "not_estimable")
        .when(F.abs(b / se) < z, "insignificant")
        .when(base.isNull() | (base == 0), "consistent")
        .when(b * base < 0, "sign_flip")
        .when(F.abs(b) < 0.5 * F.abs(base), "attenuated")
        .otherwise("consistent")
    )
    return cells.withColumn("verdict", label)


def robustness_cells(df: DataFrame, cells: Mapping[str, Column]) -> DataFrame:
    """Rows repeated for every sub-sample they belong to, in one pass."""
    tags = F.array(*[F.when(cond, F.lit(name)) for name, cond in cells.items()])
    return df.withColumn("cell", F.explode(F.filter(tags, lambda t: t.isNotNull())))


def placebo_panels(df: DataFrame, shifts: Sequence[int], first: str) -> DataFrame:
    """Treatment moved earlier by each shift, on periods before the real one only."""
    shift = F.explode(F.array(*[F.lit(int(s)) for s in shifts]))
    real = total(df, F.min(first))
    return (
        df.where(F.col("month_index") < real)
        .withColumn("shift", shift)
        .withColumn("post", (F.col("month_index") >= real - F.col("shift")).cast("int"))
    )


def placebo_products(df: DataFrame, product: str, share_treated: float, salt: str) -> DataFrame:
    """Never-treated products relabelled as treated by a stable draw, at the real date."""
    real = total(df, F.min("first_treated_month_index"))
    fake = (hash32(product, salt=salt) < int(share_treated * 2**32)).cast("int")
    return df.where(~F.col("ever_treated_product")).withColumns(
        {"fake_treated": fake, "post": (F.col("month_index") >= real).cast("int")}
    )


