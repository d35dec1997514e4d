"""Entity-month panels with exits: events, episodes, the active stock and exposure.

A loan has one row per month, so windows over a loan are bounded by the calendar. One hash
partitioning on the loan id serves the age, lag, event and episode steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymetrics.core import (
    asof_backward,
    join_null_safe,
    month_index,
    ordered,
    quantiles,
    ratio,
    scalars,
    share,
    sum_where,
    total,
)
from quaymetrics.functions.columns import map_code, safe_log
from quaymetrics.functions.lending import (
    est_ltv,
    gap_measures,
    payment,
    scheduled_balance,
    start_balance,
)

LOAN = "loan_seq_no"

# Exit codes, their class, label and priority when several are reported.
EXIT_CLASS = {
    "01": "prepayment",
    "02": "credit_event",
    "03": "credit_event",
    "09": "credit_event",
    "15": "censored",
    "16": "censored",
    "96": "censored",
}
EXIT_LABEL = {
    "01": "Prepaid or Matured (Voluntary Payoff)",
    "02": "Third Party Sale",
    "03": "Short Sale or Charge Off",
    "09": "REO Disposition",
    "15": "Whole Loan Sale",
    "16": "Reperforming loan securitizations",
    "96": "Defect prior to other termination event",
}
EXIT_PRIORITY = {"15": 1, "16": 2, "09": 3, "96": 4, "03": 5, "02": 6, "01": 7}
ADMINISTRATIVE = ("15", "16", "96")
THRESHOLDS_BP = (100, 200, 300, 400)
DECILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def derive_origination(df: DataFrame) -> DataFrame:
    """Fields coded in the loan id, and the approximate origination month."""
    seq, first = F.col(LOAN), F.col("first_payment_date")
    return df.withColumns(
        {
            "seq_product": F.substring(seq, 1, 1),
            "seq_orig_year": F.concat(F.lit("20"), F.substring(seq, 2, 2)).try_cast("bigint"),
            "seq_orig_quarter": F.substring(seq, 5, 1).try_cast("bigint"),
            "approx_origination_date": F.add_months(first, -2),
            "approx_origination_year": F.year(F.add_months(first, -2)).cast("bigint"),
        }
    )


def add_age(months: DataFrame) -> DataFrame:
    first = F.min("period").over(Window.partitionBy(LOAN))
    return months.withColumn("loan_age", month_index("period") - month_index(first) + 1)


def exit_priority(code: Column) -> Column:
    out = F
    for c, p in EXIT_PRIORITY.items():
        out = out.when(code == c, p)
    return out.otherwise(99)


def censoring_reason(code: Column) -> Column:
    out = F.when(code.isNull(), "active_at_performance_cutoff")
    for c, label in EXIT_LABEL.items():
        text = f"admin_removal_zb{c}_{label.lower().replace(' ', '_')}"
        out = out.when(code == c, F.lit(text if c in ADMINISTRATIVE else None).cast("string"))
    return out.otherwise("undocumented_zb_code")


def entity_events(months: DataFrame, orig: DataFrame) -> DataFrame:
    """One row per loan: span, exit resolved by priority, gaps, reappearance, conflicts.

    The exit is dated by the zero balance's effective month where the months have that column, and
    by the month that reports it otherwise. `ever_30d_plus` is null without a delinquency status,
    `entry_date` without a first payment date.
    """
    code, period = F.col("zero_balance_code"), F.col("period")
    dated = period
    if "zero_balance_effective_date" in months.columns:
        dated = F.coalesce("zero_balance_effective_date", period)
    late = F.first(F.lit(None).cast("boolean"))
    if "delinquency_status" in months.columns:
        late = F.coalesce(F.bool_or(F.col("delinquency_status").isin("1", "2", "3")), F.lit(False))
    if "first_payment_date" not in orig.columns:
        orig = orig.withColumn("first_payment_date", F.lit(None).cast("date"))
    orig = orig.withColumnRenamed("first_payment_date", "entry_date")
    exit_key = F.when(code.isNotNull(), F.struct(exit_priority(code).alias("p"), period))
    back = F.col("loan_age") - F.lag("loan_age").over(ordered([LOAN], "period"))
    modified = (
        F.col("modification_flag").isin("Y", "P")
        if "modification_flag" in months.columns
        else F.lit(False)
    )
    spans = (
        months.withColumn("_back", back < 0)
        .groupBy(LOAN)
        .agg(
            F.min("period").alias("observation_start"),
            F.max("period").alias("last_observed_period"),
            F.min("loan_age").alias("start_age"),
            F.max("loan_age").alias("end_age"),
            F.count(F.lit(1)).alias("n_months_observed"),
            F.coalesce(F.bool_or(modified), F.lit(False)).alias("ever_modified"),
            F.coalesce(F.bool_or("_back"), F.lit(False)).alias("modification_reset"),
            F.max_by("current_upb", "period").alias("last_upb"),
            late.alias("ever_30d_plus"),
            F.min_by(F.struct(code.alias("code"), dated.alias("at")), exit_key).alias("_exit"),
            F.count(code).alias("_exits"),
        )
    )
    exit_at = F.col("_exit.at")
    end = F.coalesce(F.least(exit_at, F.col("last_observed_period")), F.col("last_observed_period"))
    events = spans.withColumns(
        {
            "zero_balance_code": F.col("_exit.code"),
            "event_date": exit_at,
            "observation_end": end,
            "event_type": map_code("_exit.code", EXIT_CLASS, "censored"),
            "zero_balance_label": map_code("_exit.code", EXIT_LABEL, None),
            "censoring_reason": censoring_reason(F.col("_exit.code")),
            "conflicting_zb_codes": F.col("_exits") > 1,
            "reappeared_after_exit": F.coalesce(
                F.col("last_observed_period") > exit_at, F.lit(False)
            ),
        }
    ).drop("_exit", "_exits")
    span = month_index("observation_end") - month_index("observation_start") + 1
    return events.withColumns(
        {
            "censored": F.col("event_type") == "censored",
            "n_month_gaps": F.greatest(span - F.col("n_months_observed"), F.lit(0).cast("bigint")),
        }
    ).join(orig, LOAN)


def event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.sum("orig_upb").alias("orig_upb"),
        F.count_if(F.col("start_age") > 1).alias("n_left_truncated"),
        F.count_if(F.col("n_month_gaps") > 0).alias("n_with_month_gaps"),
        F.count_if("conflicting_zb_codes").alias("n_conflicting_zb"),
        F.count_if("reappeared_after_exit").alias("n_reappeared_after_exit"),
        F.min("observation_start").alias("observation_start_min"),
        F.max("observation_end").alias("observation_end_max"),
    )


def maturity_like(events: DataFrame, maturity: Column, threshold_months: int = 3) -> DataFrame:
    """Prepayments within a few months of scheduled maturity (a heuristic count)."""
    left = month_index(maturity) - month_index("event_date")
    hit = (F.col("event_type") == "prepayment") & (left <= threshold_months)
    return events.agg(
        F.count_if(F.col("event_type") == "prepayment").alias("n_prepayments"),
        F.count_if(hit).alias("n_maturity_like"),
    )


# --- point-in-time rates ----------------------------------------------------------


def monthly_rate(
    weekly: DataFrame, series: str, rule: str = "month_start", lag_days: int = 0
) -> DataFrame:
    """Last weekly observation available at each month's as-of date; none before the first."""
    obs = weekly.where(F.col(series).isNotNull()).select(
        F.date_add("date", lag_days).alias("rate_available_from"),
        F.col("date").alias("rate_obs_date"),
        F.col(series).alias("market_rate"),
    )
    bounds = obs.agg(
        F.trunc(F.min("rate_obs_date"), "month").alias("lo"),
        F.trunc(F.max("rate_obs_date"), "month").alias("hi"),
    )
    periods = bounds.select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("period")
    )
    as_of = F.last_day("period") if rule == "month_end" else F.col("period")
    return asof_backward(
        periods.withColumn("_as_of", as_of),
        obs,
        "_as_of",
        "rate_available_from",
        ["market_rate", "rate_obs_date", "rate_available_from"],
    ).drop("_as_of")


def attach_rate(df: DataFrame, monthly: DataFrame, period: str = "period") -> DataFrame:
    rates = monthly.select(F.col("period").alias(period), "market_rate", "rate_obs_date")
    return df.join(rates, period, "left")


# --- episodes ---------------------------------------------------------------------


def episodes(
    months: DataFrame, events: DataFrame, monthly: DataFrame, index: DataFrame | None = None
) -> DataFrame:
    """Loan-month episodes up to the resolved exit, with start-of-month covariates.

    `index` is (geography, period, hpi); it gives the current and origination price level and
    the twelve-month growth of the loan's area.
    """
    facts = events.select(
        LOAN,
        "event_type",
        "event_date",
        "observation_end",
        "orig_interest_rate",
        "orig_upb",
        "orig_ltv",
        "orig_loan_term",
        "credit_score",
        "property_state",
        "loan_purpose",
        "approx_origination_date",
    )
    prev = F.lag("current_upb").over(ordered([LOAN], "period"))
    base = (
        months.withColumn("_prev", prev)
        .join(facts, LOAN)
        .where(F.col("period") <= F.col("observation_end"))
        .join(monthly.select("period", "market_rate"), "period", "left")
    )
    if index is None:
        none = F.lit(None).cast("double")
        base = base.withColumns(
            {"hpi_now": none, "hpi_at_origination": none, "hpi_growth_12m": none}
        )
    else:
        base = _attach_index(base, index)
    note, age = F.col("orig_interest_rate"), F.col("loan_age")
    planned = scheduled_balance(
        F.col("orig_upb"), note, F.col("orig_loan_term").cast("double"), age - 1
    )
    balance, balance_source = start_balance(F.col("_prev"), F.col("current_upb"), planned)
    reported = (
        F.col("remaining_months_to_maturity")
        if "remaining_months_to_maturity" in months.columns
        else F.lit(None).cast("int")
    )
    left = F.coalesce(reported, F.col("orig_loan_term") - age)
    out = base.withColumns(
        {
            "upb_start_of_month": balance,
            "upb_timing_source": balance_source,
            "note_rate": note,
            "remaining_term": F.greatest(left, F.lit(1)).cast("double"),
        }
    )
    out = gap_measures(out, balance="upb_start_of_month")
    eltv = F.col("reported_eltv") if "reported_eltv" in months.columns else F.lit(None)
    ltv, ltv_source = est_ltv(
        eltv.cast("double"),
        F.col("orig_ltv"),
        F.col("upb_start_of_month"),
        F.col("orig_upb"),
        F.col("hpi_at_origination"),
        F.col("hpi_now"),
    )
    exit_month = F.coalesce(F.col("period") == F.col("event_date"), F.lit(False))
    kind = F.col("event_type")
    last = F.col("period") == F.col("observation_end")
    return out.withColumns(
        {
            "est_current_ltv": ltv,
            "ltv_source": ltv_source,
            "orig_cohort_year": F.year("approx_origination_date"),
            "exit_prepayment": (exit_month & (kind == "prepayment")).cast("int"),
            "exit_credit_event": (exit_month & (kind == "credit_event")).cast("int"),
            "exit_any": (exit_month & kind.isin("prepayment", "credit_event")).cast("int"),
            "censored_this_month": (last & (kind == "censored")).cast("int"),
        }
    ).drop("_prev", "orig_interest_rate", "event_date", "observation_end", "event_type")


def _attach_index(base: DataFrame, index: DataFrame) -> DataFrame:
    log_hpi = safe_log("hpi")
    growth = log_hpi - F.lag(log_hpi, 12).over(ordered(["geography"], "period"))
    now = index.select(
        F.col("geography").alias("property_state"),
        "period",
        F.col("hpi").alias("hpi_now"),
        growth.alias("hpi_growth_12m"),
    )
    start = index.select(
        F.col("geography").alias("property_state"),
        F.col("period").alias("_orig_month"),
        F.col("hpi").alias("hpi_at_origination"),
    )
    return (
        base.withColumn("_orig_month", F.trunc("approx_origination_date", "month"))
        .join(now, ["property_state", "period"], "left")
        .join(start, ["property_state", "_orig_month"], "left")
        .drop("_orig_month")
    )


# --- active stock -----------------------------------------------------------------


def locked_shares(gap: Column, balance: Column, thresholds: Sequence[int]) -> list[Column]:
    """Count and balance weighted shares above each threshold, as ratios of sums."""
    out = []
    for t in thresholds:
        locked = gap > t / 100.0
        out.append(share(locked).alias(f"locked_share_count_{t}"))
        top = F.sum(F.when(locked, balance).otherwise(0.0))
        out.append(ratio(top, F.sum(balance)).alias(f"locked_share_upb_{t}"))
    return out


def active_stock(
    eps: DataFrame,
    thresholds: Sequence[int] = THRESHOLDS_BP,
    refi_cut_bp: int = 50,
    geography: str = "property_state",
) -> DataFrame:
    """Geography-month stock: rates under both weights, shares, medians, deciles, exits.

    Quantiles of all measures come from one stream of (cell, measure, value), worked on in
    buckets, so no cell's values meet in one buffer.
    """
    upb, note = F.col("current_upb"), F.col("note_rate")
    rows = eps.where(F.col(geography).isNotNull() & F.col("market_rate").isNotNull()).withColumn(
        "geography", F.col(geography)
    )
    cell = ["geography", "period"]
    wanted = {
        "payment_gap": {"median_payment_gap": 0.5},
        "est_current_ltv": {"median_est_current_ltv": 0.5},
        "note_rate": {f"note_rate_p{int(q * 100)}": q for q in DECILES},
    }
    probs = {f"q{int(q * 100)}": q for q in sorted({q for w in wanted.values() for q in w.values()})}
    stream = rows.select(
        *cell,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                    for m in wanted
                ]
            )
        ),
    )
    found = quantiles(stream, [*cell, "measure"], "value", probs)
    marks = found.groupBy(*cell).agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col(f"q{int(q * 100)}"))).alias(name)
            for m, names in wanted.items()
            for name, q in names.items()
        ]
    )
    sums = (
        rows.groupBy(*cell)
        .agg(
            F.count(F.lit(1)).alias("n_active_loans"),
            F.sum(upb).alias("total_upb"),
            F.avg(note).alias("wavg_note_rate_count"),
            ratio(F.sum(note * upb), F.sum(upb)).alias("wavg_note_rate_upb"),
            F.max("market_rate").alias("market_rate"),
            *locked_shares(F.col("rate_gap"), upb, thresholds),
            F.avg("lockin_gap").alias("mean_lockin_gap"),
            F.avg("rate_gap").alias("mean_rate_gap"),
            F.avg("payment_gap").alias("mean_payment_gap"),
            share(F.col("refi_incentive") > refi_cut_bp / 100.0).alias("refi_incentive_share"),
            F.avg("exit_prepayment").alias("prepayment_rate_monthly"),
            F.avg("exit_credit_event").alias("credit_event_rate_monthly"),
            F.sum("exit_prepayment").alias("n_prepayments"),
            F.sum("exit_credit_event").alias("n_credit_events"),
            F.avg("credit_score").alias("mean_credit_score"),
            F.avg("orig_cohort_year").alias("mean_orig_cohort_year"),
            share(F.col("loan_purpose") == "P").alias("share_purchase_loans"),
        )
    )
    return join_null_safe(sums, marks, cell)


def cohort_mix(eps: DataFrame, geography: str = "property_state") -> DataFrame:
    return (
        eps.where(F.col(geography).isNotNull())
        .groupBy(F.col(geography).alias("geography"), "period", "orig_cohort_year")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("current_upb").alias("upb"))
    )


def stock_coverage(stock: DataFrame) -> DataFrame:
    """First, last and peak of the stock; attrition is measured from the peak."""
    by_period = stock.groupBy("period").agg(
        F.sum("n_active_loans").alias("n"),
        F.sum("total_upb").alias("upb"),
        F.count_distinct("geography").alias("g"),
    )
    row = F.struct("period", "n", "upb", "g")
    peak_order = F.struct(F.col("n"), (-F.unix_date("period")).alias("earlier"))
    facts = by_period.agg(
        F.min_by(row, "period").alias("a"),
        F.max_by(row, "period").alias("z"),
        F.max_by(row, peak_order).alias("p"),
    )
    return facts.select(
        F.col("a.period").alias("first_period"),
        F.col("z.period").alias("last_period"),
        F.col("a.n").alias("n_active_first"),
        F.col("z.n").alias("n_active_last"),
        F.col("p.period").alias("peak_period"),
        F.col("p.n").alias("n_active_peak"),
        F.round(100.0 * (1.0 - ratio(F.col("z.n"), F.col("p.n"))), 2).alias(
            "attrition_from_peak_pct"
        ),
        F.round(100.0 * (ratio(F.col("z.n"), F.col("a.n")) - 1.0), 2).alias(
            "net_change_first_to_last_pct"
        ),
        F.col("a.upb").alias("upb_first"),
        F.col("z.upb").alias("upb_last"),
        F.col("z.g").alias("n_geographies"),
    )


def predetermined_exposure(
    eps: DataFrame,
    as_of: str,
    post_rate: Column,
    thresholds: Sequence[int] = THRESHOLDS_BP,
    geography: str = "property_state",
) -> DataFrame:
    """Frozen pre-period coupon distribution evaluated at a later national rate level."""
    pre = eps.where(F.col("period") == F.lit(as_of).cast("date")).dropna(
        subset=[geography, "note_rate", "upb_start_of_month"]
    )
    pre = pre.withColumn("_post", post_rate)
    note, bal, post = F.col("note_rate"), F.col("upb_start_of_month"), F.col("_post")
    gap = post - note
    pgap = payment(bal, post, F.col("remaining_term")) - payment(
        bal, note, F.col("remaining_term")
    )
    below = [
        share(note < post - t / 100.0).alias(f"coupon_share_below_{t}") for t in thresholds
    ]
    geo = F.col(geography).alias("geography")
    exposure = pre.groupBy(geo).agg(
        F.count(F.lit(1)).alias("n_active_loans"),
        F.sum(bal).alias("total_upb"),
        F.avg(note).alias("wavg_note_rate_count"),
        ratio(F.sum(note * bal), F.sum(bal)).alias("wavg_note_rate_upb"),
        *locked_shares(gap, bal, thresholds),
        *below,
        F.avg(gap).alias("mean_rate_gap"),
        F.avg(F.greatest(gap, F.lit(0.0))).alias("mean_lockin_gap"),
        F.avg(pgap).alias("mean_payment_gap"),
    )
    bins = pre.groupBy(geo, (F.round(note * 4) / 4).alias("coupon")).agg(
        F.count(F.lit(1)).alias("n")
    )
    n = F.col("n").cast("double")
    hhi = bins.groupBy("geography").agg(
        (F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("coupon_share_hhi")
    )
    return exposure.join(hhi, "geography")


def geography_exposure(
    df: DataFrame,
    group: Sequence[str],
    rate: str,
    note: str,
    balance: str,
    term: str,
    thresholds: Sequence[int] = THRESHOLDS_BP,
    refi_cut_bp: int = 50,
) -> DataFrame:
    """Exposure of an arbitrary set of active loans, under count and balance weights."""
    m, r, b, n = F.col(rate), F.col(note), F.col(balance), F.col(term).cast("double")
    usable = r.isNotNull() & (b > 0) & (n > 0)
    gap = m - r
    pgap = payment(b, m, n) - payment(b, r, n)
    return (
        df.where(usable)
        .groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n_loans"),
            F.sum(b).alias("total_upb"),
            F.avg(r).alias("wavg_note_rate_count"),
            ratio(F.sum(r * b), F.sum(b)).alias("wavg_note_rate_upb"),
            *locked_shares(gap, b, thresholds),
            F.avg(F.greatest(gap, F.lit(0.0))).alias("mean_lockin_gap"),
            F.avg(pgap).alias("mean_payment_gap"),
            share(-gap > refi_cut_bp / 100.0).alias("refi_incentive_share"),
        )
    )


def score_scenario(
    stock: DataFrame,
    coefs: Mapping[str, float],
    shift: float,
    fill_mean: Sequence[str] = (),
    geography: str = "property_state",
) -> DataFrame:
    """Linear index to logistic exit hazard under a rate shift, summed by geography.

    A missing gap counts as zero; other covariates missing take their mean over the stock.
    """
    base = F.lit(float(coefs.get("intercept", 0.0)))
    for name in fill_mean:
        mean = total(stock, F.avg(name))
        base = base + float(coefs[name]) * F.coalesce(F.col(name).cast("double"), mean)
    gap = F.coalesce(F.col("rate_gap"), F.lit(0.0))
    slope = float(coefs.get("rate_gap", 0.0))

    def logistic(x: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-x))

    scored = stock.select(
        F.col(geography).alias("geography"),
        F.col("upb_start_of_month").alias("_b"),
        logistic(base + slope * gap).alias("_h0"),
        logistic(base + slope * (gap + shift)).alias("_h1"),
    )
    delta = F.col("_h1") - F.col("_h0")
    return scored.groupBy("geography").agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.sum("_h0").alias("baseline_expected_exits"),
        F.sum("_h1").alias("scenario_expected_exits"),
        F.sum(delta).alias("additional_expected_exits"),
        F.sum(delta * F.col("_b")).alias("additional_prepaid_upb"),
        ratio(F.sum(delta), F.sum("_h0")).alias("pct_change_in_exits"),
    )




# --- checks -----------------------------------------------------------------------


def panel_checks(months: DataFrame, known_codes: Sequence[str]) -> DataFrame:
    """Check table of a raw loan-month panel; severity grows with prevalence.

    The loan-level facts come from one aggregation per (loan, month) and one per loan.
    """
    code = F.col("zero_balance_code")
    w = ordered([LOAN], "period")
    seen = months.withColumns(
        {
            "_step": month_index("period") - month_index(F.lag("period").over(w)),
            "_back": F.col("loan_age") - F.lag("loan_age").over(w),
        }
    )
    per_row = seen.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_step") == 0).alias("duplicate_keys"),
        F.count_if(F.col("_back") < 0).alias("age_regressions"),
        F.count_if(F.col("_step") > 1).alias("month_gaps"),
        F.count_if(F.col("current_upb") < 0).alias("negative_balances"),
        F.count_if(code.isNotNull() & ~code.isin(*known_codes)).alias("unknown_codes"),
    )
    per_loan = (
        months.groupBy(LOAN)
        .agg(F.count(code).alias("n"), F.max("current_upb").alias("top"))
        .agg(
            F.count(F.lit(1)).alias("loans"),
            F.count_if(F.col("n") > 1).alias("loans_with_several_codes"),
            F.count_if(F.coalesce(F.col("top"), F.lit(0.0)) <= 0).alias("loans_never_positive"),
        )
    )
    facts = per_row.withColumns(scalars(per_loan))
    checks = [
        ("duplicate_keys", "rows", 0.0),
        ("age_regressions", "rows", 0.001),
        ("month_gaps", "rows", 0.05),
        ("negative_balances", "rows", 0.0),
        ("unknown_codes", "rows", 0.0),
        ("loans_with_several_codes", "loans", 0.01),
        ("loans_never_positive", "loans", 0.01),
    ]
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.col(name).cast("bigint").alias("n"),
                ratio(F.col(name), F.col(of)).alias("prevalence"),
                F.lit(tolerated).alias("tolerated"),
            )
            for name, of, tolerated in checks
        ]
    )
    return facts.select(F.inline(table)).withColumn(
        "severity",
        F.when(F.col("n") == 0, "OK")
        .when(F.col("prevalence") <= F.col("tolerated"), "SOFT")
        .otherwise("HARD"),
    )


def _check_rows(facts: DataFrame, hard: Sequence[str], soft: Sequence[str]) -> DataFrame:
    severity = {**dict.fromkeys(hard, "HARD"), **dict.fromkeys(soft, "SOFT")}
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.lit(level).alias("severity"),
                F.col(name).cast("bigint").alias("n"),
            )
            for name, level in severity.items()
        ]
    )
    return facts.select(F.inline(rows)).withColumn("passed", F.col("n") == 0)


def event_checks(events: DataFrame) -> DataFrame:
    """Invariants of the event table."""
    admin = F.col("zero_balance_code").isin(*ADMINISTRATIVE)
    facts = events.agg(
        (F.count(F.lit(1)) - F.count_distinct(LOAN)).alias("duplicate_loans"),
        F.count_if(F.col("observation_end") < F.col("observation_start")).alias("bad_order"),
        F.count_if(F.col("event_date") < F.col("observation_start")).alias("early_exit"),
        F.count_if(
            ~F.col("event_type").isin("prepayment", "credit_event", "censored")
        ).alias("unknown_event_type"),
        F.count_if(admin & ~F.col("censored")).alias("administrative_not_censored"),
        F.count_if("conflicting_zb_codes").alias("conflicting_codes"),
        F.count_if("reappeared_after_exit").alias("reappeared"),
        F.count_if(F.col("start_age") > 1).alias("left_truncated"),
        F.count_if(F.col("n_month_gaps") > 0).alias("with_gaps"),
    )
    return _check_rows(
        facts,
        [
            "duplicate_loans",
            "bad_order",
            "early_exit",
            "unknown_event_type",
            "administrative_not_censored",
        ],
        ["conflicting_codes", "reappeared", "left_truncated", "with_gaps"],
    )


def episode_checks(eps: DataFrame) -> DataFrame:
    """Invariants of the episode table."""
    gap, pgap, bal = F.col("rate_gap"), F.col("payment_gap"), F.col("upb_start_of_month")
    identity = F.abs(gap - (F.col("market_rate") - F.col("note_rate"))) > 1e-9
    opposite = (bal > 0) & (F.abs(gap) > 0.01) & (F.signum(pgap) != F.signum(gap))
    exits = eps.groupBy(LOAN).agg(F.sum("exit_any").alias("k"))
    facts = eps.agg(
        F.count_if(F.col("market_rate").isNull()).alias("no_market_rate"),
        F.count_if((F.col("exit_prepayment") == 1) & (F.col("exit_credit_event") == 1)).alias(
            "two_exit_kinds"
        ),
        F.count_if(identity).alias("gap_identity"),
        F.count_if(opposite).alias("gap_signs"),
        F.count_if((F.col("exit_any") == 1) & (bal <= 0)).alias("exit_without_balance"),
        F.count_if(F.col("remaining_term") <= 0).alias("nonpositive_term"),
    ).withColumn("several_exits", total(exits, F.count_if(F.col("k") > 1)))
    return _check_rows(
        facts,
        [
            "several_exits",
            "two_exit_kinds",
            "gap_identity",
            "gap_signs",
            "exit_without_balance",
            "nonpositive_term",
        ],
        ["no_market_rate"],
    )


def exposure_distribution(panel: DataFrame, exposure: str, covariates: Sequence[str]) -> DataFrame:
    """Distribution over geographies and correlation with covariates; one row per geography in."""
    per_geo = panel.groupBy("geography").agg(
        F.min_by(exposure, "period").alias("exposure"),
        *[F.avg(c).alias(c) for c in covariates],
    ).where(F.col("exposure").isNotNull())
    e = F.col("exposure")
    return per_geo.agg(
        F.count(F.lit(1)).alias("n_geographies"),
        F.avg(e).alias("mean"),
        F.stddev_samp(e).alias("sd"),
        F.min(e).alias("min"),
        F.percentile(e, 0.25).alias("p25"),
        F.percentile(e, 0.5).alias("median"),
        F.percentile(e, 0.75).alias("p75"),
        F.max(e).alias("max"),
        *[F.corr(e, c).alias(f"corr_{c}") for c in covariates],
    )


def extremes(panel: DataFrame, exposure: str, k: int = 5) -> DataFrame:
    """The k highest and k lowest geographies by exposure."""
    per_geo = panel.groupBy("geography").agg(
        F.min_by(exposure, "period").alias("exposure")
    ).where(F.col("exposure").isNotNull())
    top = per_geo.orderBy(F.desc("exposure"), "geography").limit(k).withColumn("end", F.lit("top"))
    low = per_geo.orderBy("exposure", "geography").limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(low)


# --- fixtures used by several queries ---------------------------------------------


def months_view(v) -> DataFrame:
    """The loan-month panel with ages and a modification flag."""
    flag = F.when(F.col("n_rows") >= 3, "Y").otherwise("N")
    return add_age(v.loan_months).withColumn("modification_flag", flag)


def originations_view(v) -> DataFrame:
    first = v.loan_months.groupBy(LOAN).agg(
        F.add_months(F.min("period"), -2).alias("approx_origination_date")
    )
    return v.originations.join(first, LOAN)


def events_view(v) -> DataFrame:
    return entity_events(months_view(v), originations_view(v))


def index_view(v) -> DataFrame:
    return (
        v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_nationkey").cast("string").alias("geography"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"),
        )
        .agg(F.round(F.avg("o_totalprice"), 4).alias("hpi"))
    )


def build_episodes(v) -> DataFrame:
    return episodes(
        months_view(v), events_view(v), monthly_rate(v.weekly_rates, "pmms30"), index_view(v)
    )


def episodes_view(v) -> DataFrame:
    """The episode table as a stored layer, built once per session and data folder."""
    return v.stored("episodes", lambda: build_episodes(v))


def stock_view(v) -> DataFrame:
    return active_stock(episodes_view(v))




def relabel_administrative(eps: DataFrame, events: DataFrame) -> DataFrame:
    """Administrative exits counted as prepayment in the month they were reported."""
    admin = events.where(F.col("zero_balance_code").isin(*ADMINISTRATIVE)).select(
        LOAN, F.col("event_date").alias("_admin")
    )
    hit = F.coalesce((F.col("period") == F.col("_admin")).cast("int"), F.lit(0))
    return (
        eps.join(admin, LOAN, "left")
        .withColumn("exit_prepayment", F.greatest("exit_prepayment", hit))
        .drop("_admin")
    )


def realign_rate(eps: DataFrame, monthly: DataFrame) -> DataFrame:
    """Episodes with the gap measured against another availability rule's rate."""
    other = monthly.select("period", F.col("market_rate").alias("_alt"))
    return (
        eps.join(other, "period", "left")
        .withColumn("rate_gap", F.col("_alt") - F.col("note_rate"))
        .where(F.col("rate_gap").isNotNull())
        .drop("_alt")
    )


def fresh_term_summary(eps: DataFrame, fresh_term: int = 360) -> DataFrame:
    """Payment gap on the remaining term against a fresh full term."""
    b, r, m, n = (
        F.col("upb_start_of_month"),
        F.col("note_rate"),
        F.col("market_rate"),
        F.col("remaining_term"),
    )
    same = payment(b, m, n) - payment(b, r, n)
    fresh = payment(b, m, F.lit(float(fresh_term))) - payment(b, r, n)
    return eps.agg(
        F.avg(same).alias("mean_payment_gap_remaining_term"),
        F.avg(fresh).alias("mean_payment_gap_fresh_term"),
        F.corr(same, fresh).alias("correlation"),
        sum_where(F.lit(1), same.isNotNull()).alias("n_known"),
    )
