"""Level-payment loan arithmetic and the gap measures built on it, as columns.

Rates are annual percents; `growth` and `discount` powers stay in codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.functions.columns import bucketize

ZERO_RATE = 1e-12

# Rate-gap bucket edges in basis points.
GAP_EDGES_BP = (-200.0, -100.0, 0.0, 100.0, 200.0, 300.0, 400.0)


def monthly(rate_pct: Column) -> Column:
    return rate_pct / 1200.0


def payment(balance: Column, rate_pct: Column, n: Column) -> Column:
    """Level monthly payment; balance / n at a zero rate, null without remaining months."""
    i = monthly(rate_pct)
    g = F.pow(1.0 + i, n)
    zero = F.abs(i) < ZERO_RATE
    return F.when(n > 0, F.when(zero, balance / n).otherwise(balance * i * g / F.when(~zero, g - 1.0)))


def scheduled_balance(principal: Column, rate_pct: Column, n: Column, elapsed: Column) -> Column:
    """Balance after `elapsed` scheduled payments, floored at zero."""
    i = monthly(rate_pct)
    k = F.greatest(elapsed.cast("double"), F.lit(0.0))
    gn, gk = F.pow(1.0 + i, n), F.pow(1.0 + i, k)
    zero = F.abs(i) < ZERO_RATE
    path = F.when(zero, principal * (1.0 - k / F.when(n != 0, n))).otherwise(
        principal * (gn - gk) / F.when(~zero, gn - 1.0)
    )
    return F.when(n > 0, F.when(k >= n, F.lit(0.0)).otherwise(F.greatest(path, F.lit(0.0))))


def remaining_term(term: Column, age: Column, floor_months: int = 1) -> Column:
    return F.greatest((term - age).cast("double"), F.lit(float(floor_months)))


def annuity_factor(months: Column, discount_pct: float) -> Column:
    """Present value of one per month."""
    d = discount_pct / 1200.0
    if abs(d) < ZERO_RATE:
        return F.greatest(months, F.lit(0.0))
    return F.greatest((1.0 - F.pow(F.lit(1.0 + d), -months)) / d, F.lit(0.0))


def gap_measures(
    df: DataFrame,
    market: str = "market_rate",
    note: str = "note_rate",
    balance: str = "balance",
    term: str = "remaining_term",
    holding_months: int = 84,
    discount_pct: float = 4.0,
    fresh_term: int | None = None,
) -> DataFrame:
    """Rate gap, positive gap, refinancing incentive, payment gap and its present value."""
    m, r, b = F.col(market), F.col(note), F.col(balance).cast("double")
    n = F.col(term).cast("double")
    gap = m - r
    pgap = payment(b, m, n) - payment(b, r, n)
    horizon = F.least(F.lit(float(holding_months)), n)
    out = {
        "rate_gap": gap,
        "lockin_gap": F.greatest(gap, F.lit(0.0)),
        "refi_incentive": -gap,
        "payment_gap": pgap,
        "pv_financing_gap": pgap * annuity_factor(horizon, discount_pct),
        "gap_bucket": bucketize(gap * 100.0, GAP_EDGES_BP),
    }
    if fresh_term is not None:
        out["payment_gap_fresh_term"] = payment(b, m, F.lit(float(fresh_term))) - payment(b, r, n)
    return df.withColumns(out)


def schedule(
    loans: DataFrame, key: str, principal: str, rate: str, term: str, months_per_task: int = 1 << 21
) -> DataFrame:
    """Full amortisation schedule: one row per loan and scheduled month, closed form.

    A small loan table makes many rows, so loans are dealt over as many tasks as their months
    need; what does not change by month is worked out once per loan.
    """
    p, r = F.col(principal).cast("double"), F.col(rate)
    n = F.col(term).cast("double")
    k = F.col("month")
    start = scheduled_balance(p, r, n, k - 1)
    interest = F.col("balance_start") * monthly(r)
    running = loans.where(F.col(term) > 0)
    months = running.agg(F.sum(F.col(term).cast("long"))).first()[0] or 0
    return (
        running.select(key, principal, rate, term)
        .repartition(math.ceil(months / months_per_task) or 1)
        .withColumn("payment", payment(p, r, n))
        .withColumn("month", F.explode(F.sequence(F.lit(1), F.col(term).cast("int"))))
        .withColumns({"balance_start": start, "balance_end": scheduled_balance(p, r, n, k)})
        .select(
            key,
            "month",
            "balance_start",
            "balance_end",
            "payment",
            interest.alias("interest"),
            (F.col("payment") - interest).alias("principal"),
        )
    )


def start_balance(
    prev: Column, current: Column, scheduled: Column
) -> tuple[Column, Column]:
    """Start-of-month balance and its source: prior month, same month, else scheduled."""
    value = F.coalesce(F.when(prev > 0, prev), F.when(current > 0, current), scheduled)
    source = (
        F.when(prev > 0, "prior_month_reported_upb")
        .when(current > 0, "same_month_reported_upb")
        .otherwise("scheduled_amortisation")
    )
    return value, source


def est_ltv(
    reported: Column,
    orig_ltv: Column,
    balance: Column,
    orig_balance: Column,
    index_at_start: Column,
    index_now: Column,
) -> tuple[Column, Column]:
    """Current loan-to-value and its source: reported, index-scaled, else balance only."""
    by_balance = orig_ltv.cast("double") * (balance / F.when(orig_balance != 0, orig_balance))
    by_index = by_balance * (index_at_start / F.when(index_now != 0, index_now))
    value = F.coalesce(reported.cast("double"), by_index, by_balance)
    source = (
        F.when(reported.isNotNull(), "freddie_reported_eltv")
        .when(
            index_now.isNotNull() & index_at_start.isNotNull(),
            "orig_ltv_x_amortisation_x_state_hpi",
        )
        .otherwise("orig_ltv_x_amortisation_only")
    )
    return value, source
