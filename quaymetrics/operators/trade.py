"""Product x partner x month flows: sourcing, margins, exposure and decompositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import (
    join_null_safe,
    month_index,
    ordered,
    quantiles,
    ratio,
    sum_where,
    total,
)
from quaymetrics.functions.columns import safe_log, stage_trade, value_measures
from quaymetrics.operators.policy import attach_treatment
from quaymetrics.session import stored

P, C, M = "product", "country_code", "month_date"


def rollup_product(df: DataFrame) -> DataFrame:
    """Ten-digit lines to headings; quantities add only where all units agree."""
    unit = F.when(F.col("unit_qy1") != "", F.col("unit_qy1"))
    units = F.count_distinct(unit)
    return (
        df.groupBy(F.substring("hs10", 1, 6).alias("hs6"), C, M)
        .agg(
            *[F.sum(c).alias(c) for c in ("con_val_mo", "dut_val_mo", "cal_dut_mo", "con_cha_mo")],
            F.sum("con_qy1_mo").alias("_q"),
            F.min(unit).alias("_u"),
            units.alias("_n"),
            F.count(F.lit(1)).alias("n_hs10_lines"),
        )
        .withColumns(
            {
                "hs6_units_mixed": F.col("_n") > 1,
                "con_qy1_mo": F.when(F.col("_n") == 1, F.col("_q")),
                "unit_qy1": F.when(F.col("_n") == 1, F.col("_u")).otherwise(""),
            }
        )
        .drop("_q", "_u", "_n")
    )


def sourcing_measures(
    df: DataFrame, treated_country: str, product: str = "hs10", value: str = "customs_value"
) -> DataFrame:
    """Supplier shares, count, concentration and the treated partner's share."""
    v = F.col(value)
    facts = df.groupBy(product, M).agg(
        F.sum(v).alias("product_month_total_value"),
        F.count_if(v > 0).alias("supplier_count_in_sample"),
        ratio(F.sum(v * v), F.sum(v) * F.sum(v)).alias("supplier_hhi_in_sample"),
        ratio(sum_where(v, F.col(C) == treated_country), F.sum(v)).alias("treated_country_share"),
    )
    return join_null_safe(df, facts, [product, M]).withColumns(
        {
            "supplier_value_share": ratio(v, F.col("product_month_total_value")),
            "alternative_source_share": 1.0 - F.col("treated_country_share"),
            "is_treated_country": F.col(C) == treated_country,
        }
    )


def extensive_margin(
    df: DataFrame, product: str = "hs10", value: str = "customs_value"
) -> DataFrame:
    """Activity, entry and exit of each product-partner flow."""
    active = F.coalesce(F.col(value), F.lit(0.0)) > 0
    before = F.lag("flow_active").over(ordered([product, C], M))
    out = df.withColumn("flow_active", active).withColumn("flow_active_lag", before)
    was = F.coalesce("flow_active_lag", F.lit(False))
    return out.withColumns(
        {
            "flow_entry": F.col("flow_active") & ~was,
            "flow_exit": ~F.col("flow_active") & was,
        }
    )


def pre_exposure(
    df: DataFrame,
    treated_country: str,
    until: str,
    product: str = "hs10",
    value: str = "customs_value",
) -> DataFrame:
    """Share of the treated partner in each product's pre-period imports."""
    v = F.col(value)
    pre = df.where(F.col(M) <= F.lit(until).cast("date"))
    share = pre.groupBy(product).agg(
        ratio(
            F.coalesce(sum_where(v, F.col(C) == treated_country), F.lit(0.0)), F.sum(v)
        ).alias("pretreatment_treated_country_share")
    )
    return join_null_safe(df, share, [product])


def event_time(df: DataFrame, product: str = "hs10", flag: str = "treated") -> DataFrame:
    """Months since the product's first treated month; null for never-treated products."""
    indexed = df.withColumn("month_index", month_index(M))
    first = indexed.where(flag).groupBy(product).agg(
        F.min("month_index").alias("first_treated_month_index")
    )
    out = join_null_safe(indexed, first, [product])
    return out.withColumns(
        {
            "event_time": F.col("month_index") - F.col("first_treated_month_index"),
            "ever_treated_product": F.col("first_treated_month_index").isNotNull(),
        }
    )


def trade_panel(
    trade: DataFrame,
    records: DataFrame,
    treated_country: str,
    pre_period_end: str,
    product: str = "hs10",
    baseline: DataFrame | None = None,
) -> DataFrame:
    """The full analytical panel from staged flows and policy records."""
    df = value_measures(stage_trade(trade))
    # Five later steps read the assessed flows, so the law is worked out once and stored.
    df = stored(attach_treatment(df, records, product=product, baseline=baseline), "assessed")
    df = event_time(df, product)
    df = sourcing_measures(df, treated_country, product)
    df = extensive_margin(df, product)
    df = pre_exposure(df, treated_country, pre_period_end, product)
    return df.withColumns(
        {
            "log_customs_unit_value": safe_log("customs_unit_value"),
            "log_landed_unit_value": safe_log("landed_unit_value_duty_inclusive"),
            "log_quantity": safe_log("quantity"),
            "log_customs_value": safe_log("customs_value"),
            "hs2_chapter": F.substring(product, 1, 2),
            "hs6": F.substring(product, 1, 6),
            "hs8": F.substring(product, 1, 8),
            "flow_id": F.concat_ws("-", product, C),
            "month_key": F.date_format(M, "yyyy-MM"),
        }
    )


# --- descriptives -----------------------------------------------------------------


def monthly_aggregates(panel: DataFrame) -> DataFrame:
    v, q = F.sum("customs_value"), F.sum("quantity")
    d, b = F.sum("calculated_duties"), F.sum("dutiable_value")
    return panel.groupBy(M, "is_treated_country").agg(
        v.alias("customs_value"),
        q.alias("quantity"),
        d.alias("calculated_duties"),
        b.alias("dutiable_value"),
        F.count_distinct("hs6").alias("n_products"),
        F.when(b > 0, d / b).alias("trade_weighted_realised_duty_rate"),
        F.when(q > 0, v / q).alias("aggregate_customs_unit_value"),
    )


def treated_share(panel: DataFrame, treated_country: str) -> DataFrame:
    v = F.col("customs_value")
    mine = F.sum(F.when(F.col(C) == treated_country, v).otherwise(0.0))
    return panel.groupBy(M, "ever_treated_product").agg(
        F.sum(v).alias("total_value"),
        mine.alias("treated_country_value"),
        ratio(mine, F.sum(v)).alias("treated_country_share"),
    )


def weighted_tariff(panel: DataFrame, treated_country: str) -> DataFrame:
    v = F.col("customs_value")
    return (
        panel.where(F.col(C) == treated_country)
        .groupBy(M)
        .agg(
            ratio(F.sum(F.col("additional_tariff_rate") * v), F.sum(v)).alias(
                "trade_weighted_additional_tariff"
            ),
            F.sum(v).alias("customs_value"),
        )
    )


def concentration(panel: DataFrame) -> DataFrame:
    return panel.groupBy(M, "ever_treated_product").agg(
        F.avg("supplier_hhi_in_sample").alias("mean_supplier_hhi_in_sample"),
        F.avg("supplier_count_in_sample").alias("mean_supplier_count"),
        F.count_if("flow_entry").alias("flow_entries"),
        F.count_if("flow_exit").alias("flow_exits"),
    )


def sector_table(panel: DataFrame, sector: str | Column) -> DataFrame:
    s = F.col(sector) if isinstance(sector, str) else sector
    return panel.groupBy(s.alias("sector")).agg(
        F.count_distinct("hs6").alias("n_products"),
        F.avg(F.col("ever_treated_product").cast("double")).alias("share_products_treated"),
        F.avg("pretreatment_treated_country_share").alias("mean_pretreat_dependence"),
        F.sum("customs_value").alias("customs_value"),
    )


# --- decompositions ---------------------------------------------------------------


def _inside(lo: int, hi: int, event: str = "event_time") -> Column:
    return F.col(event).isNotNull() & F.col(event).between(lo, hi)


def pre_post(
    df: DataFrame, keys: Sequence[str], value: str, pre: Column, post: Column
) -> DataFrame:
    """Average value and activity of each key before and after, zero where it is absent.

    Both windows come from one aggregation; keys seen in neither are left out.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    facts = df.where(pre | post).groupBy(*keys).agg(
        F.avg(F.when(pre, v)).alias("pre_value"),
        F.avg(F.when(post, v)).alias("post_value"),
        F.bool_or(F.when(pre, v > 0)).alias("pre_active"),
        F.bool_or(F.when(post, v > 0)).alias("post_active"),
    )
    return facts.select(
        *keys,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pre_value", "post_value")],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("pre_active", "post_active")],
    )


def full_pre_post(pre: DataFrame, post: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two tables full-joined on their keys, a missing side counting as zero."""
    a = pre.select(*keys, F.col(value).alias("pre_value"))
    b = post.select(*keys, F.col(value).alias("post_value"))
    return a.join(b, list(keys), "full").select(
        *keys,
        F.coalesce("pre_value", F.lit(0.0)).alias("pre_value"),
        F.coalesce("post_value", F.lit(0.0)).alias("post_value"),
    )


def decompose(
    panel: DataFrame,
    treated_country: str,
    pre: tuple[int, int] = (-12, -1),
    post: tuple[int, int] = (1, 10),
    product: str = "hs6",
) -> DataFrame:
    """Change of imports by margin: intensive, extensive, treated and alternative partners."""
    j = pre_post(panel, [product, C], "customs_value", _inside(*pre), _inside(*post))
    mine = F.col(C) == treated_country
    delta = F.col("post_value") - F.col("pre_value")
    was, now = F.col("pre_active"), F.col("post_active")
    intensive, extensive = was & now, was != now

    def part(cond: Column, value: Column = delta) -> Column:
        return F.sum(F.when(cond, value).otherwise(0.0))

    out = j.groupBy(product).agg(
        part(mine & intensive).alias("treated_intensive"),
        part(mine & extensive).alias("treated_extensive"),
        part(~mine & intensive).alias("alternative_intensive"),
        part(~mine & extensive).alias("alternative_extensive"),
        F.sum(delta).alias("total_change"),
        part(mine, F.col("pre_value")).alias("pre_treated_value"),
        part(~mine, F.col("pre_value")).alias("pre_alternative_value"),
        F.sum("pre_value").alias("pre_total_value"),
        F.sum("post_value").alias("post_total_value"),
        F.count_if(~mine & ~was & now).alias("n_alt_suppliers_entered"),
        F.count_if(~mine & was & ~now).alias("n_alt_suppliers_exited"),
        F.count_if(mine & was & ~now).alias("n_treated_flows_exited"),
    )
    return _ratios(
        out.withColumns(
            {
                "treated_total": F.col("treated_intensive") + F.col("treated_extensive"),
                "alternative_total": F.col("alternative_intensive")
                + F.col("alternative_extensive"),
            }
        )
    )


def _ratios(df: DataFrame) -> DataFrame:
    t, pre = F.col("treated_total"), F.col("pre_treated_value")
    return df.withColumns(
        {
            "treated_pct_change": F.when(pre > 0, t / pre),
            "replacement_ratio": F.when(t < 0, -F.col("alternative_total") / t),
        }
    )


def decompose_totals(by_product: DataFrame, product: str = "hs6") -> DataFrame:
    """The table summed over products, with its ratios rebuilt from the sums."""
    rates = ("treated_pct_change", "replacement_ratio")
    cols = [c for c in by_product.columns if c != product and c not in rates]
    return _ratios(by_product.agg(*[F.sum(c).alias(c) for c in cols]))


def decompose_adjusted(
    panel: DataFrame,
    treated_country: str,
    pre: tuple[int, int] = (-12, -1),
    post: tuple[int, int] = (1, 10),
    product: str = "hs6",
) -> DataFrame:
    """Change net of the growth never-treated products had in the same calendar months."""
    treated = panel.where("ever_treated_product")
    span = treated.where(_inside(pre[0], post[1]))
    months = span.groupBy("month_index").agg(
        F.bool_or(F.col("event_time") <= pre[1]).alias("_pre"),
        F.bool_or(F.col("event_time") >= post[0]).alias("_post"),
    )
    control = panel.where(~F.col("ever_treated_product")).join(months, "month_index")
    v = F.coalesce("customs_value", F.lit(0.0))
    growth = control.groupBy(C).agg(
        ratio(F.avg(F.when(F.col("_post"), v)), F.avg(F.when(F.col("_pre"), v))).alias("growth")
    )
    j = pre_post(treated, [product, C], "customs_value", _inside(*pre), _inside(*post))
    cells = j.join(growth, C, "left").withColumn("_cf", F.col("pre_value") * F.col("growth"))
    excess = F.sum(F.col("post_value") - F.col("_cf"))
    return cells.groupBy(C).agg(
        F.sum("pre_value").alias("pre_monthly_value"),
        F.sum("post_value").alias("post_monthly_value"),
        F.sum("_cf").alias("counterfactual_post_value"),
        excess.alias("excess_change"),
        F.max("growth").alias("control_growth_factor"),
        (F.first(C) == treated_country).alias("is_treated_country"),
        F.when(F.sum("_cf") > 0, excess / F.sum("_cf")).alias("excess_pct_vs_counterfactual"),
    )


def country_gains(
    panel: DataFrame,
    treated_country: str,
    pre: tuple[int, int] = (-12, -1),
    post: tuple[int, int] = (1, 10),
    product: str = "hs6",
) -> DataFrame:
    """Monthly-average gains per partner with shares before and after."""
    j = pre_post(panel, [product, C], "customs_value", _inside(*pre), _inside(*post))
    out = j.groupBy(C).agg(
        F.sum("pre_value").alias("pre_monthly_value"),
        F.sum("post_value").alias("post_monthly_value"),
    )
    a, b = F.col("pre_monthly_value"), F.col("post_monthly_value")
    ta, tb = total(j, F.sum("pre_value")), total(j, F.sum("post_value"))
    return out.withColumns(
        {
            "change": b - a,
            "pct_change": F.when(a > 0, (b - a) / a),
            "is_treated_country": F.col(C) == treated_country,
            "pre_share": ratio(a, ta),
            "post_share": ratio(b, tb),
        }
    ).withColumn("share_change", F.col("post_share") - F.col("pre_share"))


def split_by_dependence(
    panel: DataFrame,
    by_product: DataFrame,
    treated_country: str,
    pre: tuple[int, int] = (-12, -1),
    product: str = "hs6",
) -> DataFrame:
    """Heterogeneity at the median pre-period dependence, rebuilt from values per heading."""
    v = F.col("customs_value")
    dep = (
        panel.where(_inside(*pre))
        .groupBy(product)
        .agg(
            ratio(
                F.coalesce(sum_where(v, F.col(C) == treated_country), F.lit(0.0)), F.sum(v)
            ).alias("dependence")
        )
        .where(F.col("dependence").isNotNull())
        .join(by_product, product)
    )
    cut = quantiles(dep, [], "dependence", {"cut": 0.5}).scalar()
    group = F.when(F.col("dependence") > cut, "high_dependence").otherwise("low_dependence")
    labelled = dep.withColumn("dependence_group", group)
    medians = quantiles(
        labelled, ["dependence_group"], "replacement_ratio", {"median_replacement_ratio": 0.5}
    )
    sums = labelled.groupBy("dependence_group").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.sum("treated_total").alias("treated_change"),
        F.sum("alternative_total").alias("alternative_change"),
        F.sum("pre_treated_value").alias("pre_treated_value"),
        ratio(F.sum("treated_total"), F.sum("pre_treated_value")).alias("treated_pct_change"),
    )
    return join_null_safe(sums, medians, ["dependence_group"])


# --- industry exposure ------------------------------------------------------------


def commodity_exposure(
    panel: DataFrame, mapping: DataFrame, pre_end_index: int, product: str = "hs6"
) -> DataFrame:
    """Peak added rate per commodity under pre-period import weights; unmapped are counted."""
    pre = F.col("month_index") <= pre_end_index
    products = panel.groupBy(product).agg(
        sum_where(F.col("customs_value"), pre).alias("w"),
        F.max("additional_tariff_rate").alias("peak"),
    ).where(F.col("w").isNotNull())
    linked = products.join(mapping, product, "left")
    w = F.col("w")
    unmapped = total(linked, F.count_if(F.col("commodity_code").isNull()))
    return (
        linked.where(F.col("commodity_code").isNotNull())
        .groupBy("commodity_code")
        .agg(
            ratio(F.sum(F.col("peak") * w), F.sum(w)).alias("commodity_tariff_exposure"),
            F.sum(w).alias("pre_import_value"),
            F.count(F.lit(1)).alias("n_products"),
            F.count_if(F.col("peak") > 0).alias("n_treated_products"),
        )
        .withColumn("n_unmapped_products", unmapped)
    )


def io_exposure(
    exposure: DataFrame,
    direct: DataFrame,
    chain: DataFrame,
    protection_cut: float = 0.01,
    cost_cut: float = 0.005,
) -> DataFrame:
    """Own-output, direct-input and full-chain exposure per industry, never collapsed to one.

    The requirement matrices stay long: a product with the exposure vector is a join and a sum.
    """
    ce = exposure.select("commodity_code", F.col("commodity_tariff_exposure").alias("x"))

    def through(matrix: DataFrame, weight: str, out: str) -> DataFrame:
        return (
            matrix.join(ce, "commodity_code")
            .groupBy("industry_code")
            .agg(F.sum(F.col(weight) * F.col("x")).alias(out))
        )

    own = (
        direct.select("industry_code")
        .distinct()
        .join(
            ce.select(
                F.col("commodity_code").alias("industry_code"),
                F.col("x").alias("output_protection_exposure"),
            ),
            "industry_code",
            "left",
        )
    )
    cost = through(direct, "direct_requirement", "imported_input_cost_exposure")
    down = through(chain, "total_requirement", "downstream_total_requirements_exposure")
    out = own.join(cost, "industry_code", "full").join(down, "industry_code", "full").fillna(0.0)
    p, c = F.col("output_protection_exposure"), F.col("imported_input_cost_exposure")
    label = (
        F.when((p > protection_cut) & (c > cost_cut), "BOTH_PROTECTED_AND_COST_EXPOSED")
        .when(p > protection_cut, "PROTECTED_ONLY")
        .when(c > cost_cut, "INPUT_COST_EXPOSED_ONLY")
        .otherwise("LITTLE_DIRECT_EXPOSURE")
    )
    return out.withColumn("exposure_class", label)


def industry_index(obs: DataFrame, link: DataFrame) -> DataFrame:
    """Component series averaged to an industry index, with the number of components.

    `link` has one row per industry and component (bea_industry, naics). A series without a
    code is read where `link` has a row without one; it counts as no component.
    """
    links = link.select("bea_industry", "naics").distinct()
    return (
        join_null_safe(obs, links, ["naics"], "inner")
        .groupBy("bea_industry", M)
        .agg(
            F.avg("index_value").alias("ppi_index"),
            F.count_distinct("naics").alias("n_component_series"),
        )
        .withColumns({"log_ppi": safe_log("ppi_index"), "month_index": month_index(M)})
    )


def shortfall_bound(panel: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Share of value on which the realised duty is well short of the statutory one."""
    gap = F.col("total_modeled_tariff_rate") - F.col("realised_duty_rate_on_dutiable")
    short = gap > tolerance
    v = F.col("customs_value")
    rows = panel.where(
        F.col("is_treated_country")
        & (F.col("additional_tariff_rate") > 0)
        & (F.col("dutiable_value") > 0)
        & (v > 0)
    )
    below = F.sum(F.when(short, v).otherwise(0.0))
    medians = quantiles(rows, [M], gap, {"median_gap": 0.5})
    sums = rows.groupBy(M).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if(short).alias("n_short"),
        F.sum(v).alias("customs_value"),
        below.alias("customs_value_short"),
        ratio(F.count_if(short), F.count(F.lit(1))).alias("share_obs_short"),
        ratio(below, F.sum(v)).alias("share_value_short"),
    )
    return join_null_safe(sums, medians, [M])


# --- sourcing counterfactual ------------------------------------------------------


def pre_post_shares(panel: DataFrame, treated_country: str, product: str = "hs10") -> DataFrame:
    """Partner shares before and after treatment and the rate change faced, per product."""
    pre, post = F.col("event_time") < 0, F.col("event_time") >= 0
    v = F.col("customs_value")
    cells = panel.groupBy(product, C).agg(
        sum_where(v, pre).alias("pre_value"),
        sum_where(v, post).alias("post_value"),
        F.avg(F.when(post, F.col("additional_tariff_rate"))).alias("tariff_change"),
    )
    sums = cells.groupBy(product).agg(
        F.sum("pre_value").alias("_a"),
        F.sum("post_value").alias("_b"),
        F.sum(F.when(F.col(C) == treated_country, F.col("pre_value"))).alias("_mine"),
    )
    return (
        cells.where(F.col("pre_value").isNotNull())
        .join(sums.where(F.col("_mine") > 0), product)
        .select(
            product,
            C,
            "pre_value",
            ratio(F.col("pre_value"), F.col("_a")).alias("share_pre"),
            F.coalesce(ratio(F.col("post_value"), F.col("_b")), F.lit(0.0)).alias("share_post"),
            F.coalesce("tariff_change", F.lit(0.0)).alias("tariff_change"),
        )
    )


def ces_counterfactual(
    shares: DataFrame, sigmas: Sequence[float], product: str = "hs10"
) -> DataFrame:
    """CES shares and the exact price index of each product at every elasticity.

    The grid is exploded from a literal array. At an elasticity of one the index is the
    share-weighted geometric mean.
    """
    grid = shares.withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    up = 1.0 + F.col("tariff_change")
    w = F.col("share_pre") * F.pow(up, 1.0 - F.col("sigma"))
    rows = grid.withColumn("_w", w)
    sums = rows.groupBy(product, "sigma").agg(
        F.sum("_w").alias("_sum"), F.sum(F.col("share_pre") * F.ln(up)).alias("_geo")
    )
    one = F.abs(F.col("sigma") - 1.0) < 1e-12
    log_index = F.when(one, F.col("_geo")).otherwise(
        F.ln("_sum") / F.when(~one, 1.0 - F.col("sigma"))
    )
    return (
        rows.join(sums, [product, "sigma"])
        .withColumns(
            {
                "share_counterfactual": ratio(F.col("_w"), F.col("_sum")),
                "log_price_index_change": log_index,
                "price_index_change": F.exp(log_index),
            }
        )
        .withColumn("share_change", F.col("share_counterfactual") - F.col("share_pre"))
        .drop("_w", "_sum", "_geo")
    )


def ces_summary(cf: DataFrame, treated_country: str, product: str = "hs10") -> DataFrame:
    """Value-weighted bundle cost and treated share per elasticity."""
    weights = cf.groupBy("sigma", product).agg(F.sum("pre_value").alias("_w"))
    prices = (
        cf.groupBy("sigma", product)
        .agg(F.max("log_price_index_change").alias("p"))
        .join(weights, ["sigma", product])
        .groupBy("sigma")
        .agg(
            ratio(F.sum(F.col("p") * F.col("_w")), F.sum("_w")).alias(
                "aggregate_log_price_index_change"
            )
        )
    )
    w = F.col("_w")
    mine = (
        cf.where(F.col(C) == treated_country)
        .join(weights, ["sigma", product])
        .groupBy("sigma")
        .agg(
            ratio(F.sum(F.col("share_pre") * w), F.sum(w)).alias("treated_share_pre"),
            ratio(F.sum(F.col("share_counterfactual") * w), F.sum(w)).alias(
                "treated_share_counterfactual"
            ),
            ratio(F.sum(F.col("share_post") * w), F.sum(w)).alias("treated_share_observed"),
        )
    )
    return prices.join(mine, "sigma")


def best_sigma(summary: DataFrame) -> DataFrame:
    """The elasticity whose treated share is closest to the observed one, lowest on ties."""
    miss = F.abs(F.col("treated_share_counterfactual") - F.col("treated_share_observed"))
    return summary.agg(
        F.min_by("sigma", F.struct(F.round(miss, 12), F.col("sigma"))).alias("sigma"),
        F.min(miss).alias("miss"),
    )
