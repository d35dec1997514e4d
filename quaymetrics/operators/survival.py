"""Person-period data, hazards, survival curves and hazard models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import (
    month_index,
    quantiles,
    rows_before,
    rows_to_here,
)
from quaymetrics.functions.columns import bucketize, safe_log
from quaymetrics.operators.estimators import (
    cluster_meat,
    coefficient_table,
    cross_products,
    linear,
)
from quaymetrics.operators.sampling import draw

LOAN = "loan_seq_no"
AGE_EDGES = (0, 12, 24, 48, 120)


def age_bin(age: Column, edges: Sequence[int] = AGE_EDGES) -> Column:
    labels = [f"age_{a}_{b}" for a, b in zip(edges, edges[1:], strict=False)]
    return bucketize(age, edges[1:-1], labels)


def discrete_time(
    eps: DataFrame,
    split: str,
    out_of_time: bool = False,
    fraction: float = 1.0,
    salt: str = "",
    edges: Sequence[int] = AGE_EDGES,
) -> DataFrame:
    """Estimation (before the split) or evaluation (from it) loan-months.

    Exit months are all kept; others are drawn by loan, and weighted by the inverse of their
    inclusion probability.
    """
    cut = F.lit(split).cast("date")
    df = eps.where(F.col("market_rate").isNotNull() & F.col("rate_gap").isNotNull())
    df = df.where(F.col("period") >= cut) if out_of_time else df.where(F.col("period") < cut)
    event = F.col("exit_any") == 1
    if fraction < 1.0:
        df = df.where(event | draw(LOAN, fraction, salt))
    return df.withColumns(
        {
            "age_bin": age_bin(F.col("loan_age"), edges),
            "log_orig_upb": safe_log("orig_upb"),
            "calendar_year": F.year("period"),
            "period_index": month_index("period"),
            "sampling_weight": F.when(event, 1.0).otherwise(1.0 / fraction),
        }
    )


def loan_level(eps: DataFrame) -> DataFrame:
    """One row per loan: entry and exit age, event code, first and last covariates."""

    def first(c: str) -> Column:
        return F.min_by(c, "period")

    def last(c: str) -> Column:
        return F.max_by(c, "period")

    rows = eps.groupBy(LOAN).agg(
        F.min("loan_age").alias("entry_age"),
        F.max("loan_age").alias("exit_age"),
        F.max("exit_prepayment").alias("is_prepay"),
        F.max("exit_credit_event").alias("is_credit"),
        first("rate_gap").alias("rate_gap_at_entry"),
        last("rate_gap").alias("rate_gap_at_exit"),
        F.avg("lockin_gap").alias("mean_lockin_gap"),
        last("payment_gap").alias("payment_gap_at_exit"),
        *[
            first(c).alias(c)
            for c in (
                "note_rate",
                "credit_score",
                "orig_ltv",
                "orig_upb",
                "property_state",
                "loan_purpose",
                "orig_cohort_year",
            )
        ],
        last("est_current_ltv").alias("est_current_ltv_at_exit"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count(F.lit(1)).alias("n_months_observed"),
    )
    return rows.withColumns(
        {
            "event_code": F.when(F.col("is_prepay") == 1, 1)
            .when(F.col("is_credit") == 1, 2)
            .otherwise(0),
            "months_at_risk": F.col("exit_age") - F.col("entry_age") + 1,
            "left_truncated": F.col("entry_age") > 1,
        }
    )


# --- survival curves --------------------------------------------------------------


def risk_table(
    loans: DataFrame,
    group: Sequence[str],
    entry: str,
    exit_: str,
    code: str,
    causes: Sequence[int],
) -> DataFrame:
    """Per age: the risk set (entered before, not yet out) and events by cause.

    Entries and exits are counted per age first; the running sums are over ages.
    """
    moves = loans.select(
        *group,
        F.explode(
            F.array(
                F.struct(
                    F.col(entry).cast("bigint").alias("age"),
                    F.lit(1).alias("enter"),
                    F.lit(0).alias("leave"),
                    F.lit(-1).alias("cause"),
                ),
                F.struct(
                    F.col(exit_).cast("bigint").alias("age"),
                    F.lit(0).alias("enter"),
                    F.lit(1).alias("leave"),
                    F.col(code).cast("int").alias("cause"),
                ),
            )
        ).alias("_m"),
    ).select(*group, "_m.*")
    ages = moves.groupBy(*group, "age").agg(
        F.sum("enter").alias("enter"),
        F.sum("leave").alias("leave"),
        *[F.count_if(F.col("cause") == k).alias(f"d{k}") for k in causes],
    )
    w = rows_before(group, "age")
    at_risk = F.coalesce(F.sum("enter").over(w), F.lit(0)) - F.coalesce(
        F.sum("leave").over(w), F.lit(0)
    )
    return ages.withColumn("n_at_risk", at_risk)


def kaplan_meier(
    loans: DataFrame, group: Sequence[str], entry: str, exit_: str, code: str, cause: int = 1
) -> DataFrame:
    """Cause-specific survival with left truncation; ages with an empty risk set are skipped."""
    table = risk_table(loans, group, entry, exit_, code, [cause])
    d, n = F.col(f"d{cause}"), F.col("n_at_risk")
    steps = table.where((d > 0) & (n > 0))
    return steps.select(
        *group,
        "age",
        "n_at_risk",
        d.alias("n_events"),
        F.product(1.0 - d / n).over(rows_to_here(group, "age")).alias("survival"),
    )


def cumulative_incidence(
    loans: DataFrame,
    group: Sequence[str],
    entry: str,
    exit_: str,
    code: str,
    causes: Sequence[int] = (1, 2),
) -> DataFrame:
    """Aalen-Johansen incidence of competing causes."""
    table = risk_table(loans, group, entry, exit_, code, causes)
    d = sum((F.col(f"d{k}") for k in causes), F.lit(0))
    n = F.col("n_at_risk")
    steps = table.withColumn("n_events_all", d).where((F.col("n_events_all") > 0) & (n > 0))
    before = F.coalesce(
        F.product(1.0 - F.col("n_events_all") / n).over(rows_before(group, "age")), F.lit(1.0)
    )
    steps = steps.withColumn("_before", before)
    here = rows_to_here(group, "age")
    return steps.select(
        *group,
        "age",
        "n_at_risk",
        "n_events_all",
        *[
            F.sum(F.col("_before") * F.col(f"d{k}") / n).over(here).alias(f"cif_cause_{k}")
            for k in causes
        ],
    )


# --- descriptive hazards ----------------------------------------------------------


def hazard_profile(df: DataFrame, by: Sequence[str], outcome: str) -> DataFrame:
    """Empirical hazard by each of several groupings, stacked, from one pass."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("profile"), F.col(c).cast("string").alias("bin"))
                for c in by
            ]
        )
    )
    return (
        df.select(pairs.alias("_p"), outcome, "loan_age", "rate_gap")
        .groupBy(F.col("_p.profile").alias("profile"), F.col("_p.bin").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n_at_risk"),
            F.sum(outcome).alias("n_events"),
            F.avg(outcome).alias("hazard"),
            F.avg("loan_age").alias("mean_age"),
            F.avg("rate_gap").alias("mean_rate_gap"),
        )
    )


def hazard_by(df: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    """Monthly hazard by each pre-specified subgroup, stacked."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("n"), g.cast("string").alias("v"))
                for n, g in groups.items()
            ]
        )
    )
    return (
        df.select(pairs.alias("_p"), LOAN, "exit_prepayment", "rate_gap", "payment_gap")
        .groupBy(F.col("_p.n").alias("grouping_name"), F.col("_p.v").alias("group_value"))
        .agg(
            F.count(F.lit(1)).alias("n_loan_months"),
            F.count_distinct(LOAN).alias("n_loans"),
            F.sum("exit_prepayment").alias("n_prepayments"),
            F.avg("exit_prepayment").alias("monthly_prepay_hazard"),
            F.avg("rate_gap").alias("mean_rate_gap"),
            F.avg("payment_gap").alias("mean_payment_gap"),
        )
    )


# --- models -----------------------------------------------------------------------


def hazard_glm(
    df: DataFrame,
    outcome: str,
    covariates: Sequence[str],
    cluster: str,
    link: str = "logit",
    weight: str = "sampling_weight",
) -> DataFrame:
    """Discrete-time hazard model with age dummies and cluster-robust errors.

    The fit is MLlib's; bread and meat of the sandwich are two aggregations. It has converged if it
    ended before its last round, as it does not where a level has no events, and if a further Newton
    step, from the score equations at the estimates, would not move them.
    """
    levels = [
        r[0]
        for r in df.where(F.col("age_bin").isNotNull())
        .select("age_bin")
        .distinct()
        .orderBy("age_bin")
        .collect()
    ]
    clean = df.dropna(subset=[outcome, *covariates]).withColumns(
        {f"is_{a}": (F.col("age_bin") == a).cast("double") for a in levels[1:]}
    )
    names = [*covariates, *[f"is_{a}" for a in levels[1:]]]
    clean = clean.withColumns({c: F.col(c).cast("double") for c in (*names, outcome)})
    spread = clean.agg(*[F.stddev_pop(c).alias(c) for c in names]).first()
    names = [c for c in names if spread[c] and spread[c] > 0]
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(
        clean.select(*names, outcome, cluster, weight)
    )
    data = data.persist()
    try:
        model = GeneralizedLinearRegression(
            family="binomial",
            link=link,
            featuresCol="_x",
            labelCol=outcome,
            weightCol=weight,
            maxIter=100,
            tol=1e-8,
        ).fit(data)
        rounds = int(model.summary.numIterations)
        beta = np.array([model.intercept, *model.coefficients.toArray()])
        cols = [F.lit(1.0), *[F.col(c) for c in names]]
        eta = linear(beta, cols)
        if link == "cloglog":
            slope = F.exp(eta - F.exp(eta))
            mu = -F.expm1(-F.exp(eta))
        else:
            mu = 1.0 / (1.0 + F.exp(-eta))
            slope = mu * (1.0 - mu)
        scored = data.withColumns({"_mu": mu, "_d": slope})
        var = F.greatest(F.col("_mu") * (1.0 - F.col("_mu")), F.lit(1e-12))
        w = F.col(weight)
        bread, n = cross_products(scored, cols, w * F.col("_d") * F.col("_d") / var)
        resid = w * (F.col(outcome) - F.col("_mu")) * F.col("_d") / var
        meat, g = cluster_meat(scored, [c * resid for c in cols], [cluster])
        inv = np.linalg.pinv(bread)
        score = scored.agg(*[F.sum(c * resid).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        step = inv @ np.array([*score], dtype=float)
        settled = bool(np.all(np.abs(step) <= 1e-6 * (1.0 + np.abs(beta))))
        vcov = inv @ meat @ inv * (g / max(g - 1, 1)) * ((n - 1) / max(n - len(cols), 1))
        effect = scored.agg(F.avg("_d").alias("d"), F.sum(outcome).alias("e")).first()
    finally:
        data.unpersist()
    table = coefficient_table(
        df, ["intercept", *names], beta, vcov, g - 1, n_obs=n, n_clusters=g, link=link,
        n_events=int(effect["e"]), rounds=rounds, converged=settled and rounds < 100,
    )
    return table.withColumns(
        {
            "hazard_ratio": F.exp("estimate"),
            "average_marginal_effect": F.when(
                F.col("term") != "intercept", F.col("estimate") * float(effect["d"])
            ),
        }
    )


def gbt_benchmark(
    train: DataFrame,
    test: DataFrame,
    outcome: str,
    covariates: Sequence[str],
    trees: int = 20,
    depth: int = 4,
    bins: int = 10,
    seed: int = 7,
) -> DataFrame:
    """Out-of-time boosted trees: AUC, Brier score and calibration by quantile bin."""
    feats = [*covariates, "loan_age", "payment_gap", "period_index"]
    assemble = VectorAssembler(inputCols=feats, outputCol="_x")

    def prepare(df: DataFrame) -> DataFrame:
        typed = df.select(*[F.col(c).cast("double").alias(c) for c in (*feats, outcome)])
        return assemble.transform(typed.dropna())

    model = GBTClassifier(
        featuresCol="_x", labelCol=outcome, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed
    ).fit(prepare(train))
    scored = model.transform(prepare(test)).withColumn(
        "_p", vector_to_array("probability").getItem(1)
    )
    auc = BinaryClassificationEvaluator(labelCol=outcome, rawPredictionCol="rawPrediction").evaluate(
        scored
    )
    rows = scored.select("_p", F.col(outcome).alias("_y"))
    cuts = quantiles(rows, [], "_p", {f"q{i}": i / bins for i in range(1, bins)})
    cut_row = cuts.first()
    edges = sorted({cut_row[f"q{i}"] for i in range(1, bins)})
    err = F.col("_p") - F.col("_y")
    brier = rows.agg(F.avg(err * err)).scalar()
    return (
        rows.groupBy(bucketize("_p", edges).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("_p").alias("mean_predicted"),
            F.avg("_y").alias("fraction_positive"),
        )
        .withColumns({"auc": F.lit(float(auc)), "brier": brier})
    )


