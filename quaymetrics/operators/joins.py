"""Lookup joins with contracts, prefix matches, crosswalks and panel skeletons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import join_null_safe, ordered, ratio, require_none, total
from quaymetrics.functions.columns import safe_log


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys))


@dataclass(frozen=True)
class Enrichment:
    """An optional lookup source; its value columns are prefixed with its name."""

    name: str
    source: DataFrame | None
    keys: Sequence[str]
    required: bool = False


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def enrich(
    panel: DataFrame, adapters: Sequence[Enrichment], one_to_one: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Left-join lookups many-to-one (or one-to-one) and report the coverage of each.

    A source with repeated keys fails before it can multiply rows. Unmatched rows stay null.
    """
    out, marks, absent = panel, [], []
    for a in adapters:
        if a.source is None:
            if a.required:
                raise ValueError(f"required enrichment {a.name} is unavailable")
            absent.append(a.name)
            continue
        require_none(
            duplicate_keys(a.source, a.keys), F.lit(True), f"{a.name} has duplicate join keys"
        )
        if one_to_one:
            require_none(
                duplicate_keys(panel, a.keys), F.lit(True), f"{a.name}: panel keys are not unique"
            )
        mark = f"_{a.name}_matched"
        values = [c for c in a.source.columns if c not in a.keys]
        lookup = a.source.select(
            *a.keys, *[F.col(c).alias(f"{a.name}__{c}") for c in values], F.lit(True).alias(mark)
        )
        out = out.join(lookup, list(a.keys), "left")
        marks.append((a.name, mark))
    facts = out.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(m).alias(n) for n, m in marks]
    )
    rows = [
        F.struct(
            F.lit(n).alias("name"),
            F.lit("joined").alias("status"),
            F.col(n).alias("matched_rows"),
            F.col("total").alias("total_rows"),
            ratio(F.col(n), F.col("total")).alias("coverage_rate"),
        )
        for n, _ in marks
    ] + [
        F.struct(
            F.lit(n).alias("name"),
            F.lit("unavailable_optional").alias("status"),
            F.lit(0).cast("bigint").alias("matched_rows"),
            F.col("total").alias("total_rows"),
            F.lit(None).cast("double").alias("coverage_rate"),
        )
        for n in absent
    ]
    coverage = facts.select(F.inline(F.array(*rows)))
    return out.drop(*[m for _, m in marks]), coverage


def skeleton(
    sources: Sequence[DataFrame], key: str, first: int, last: int, presence: DataFrame
) -> DataFrame:
    """Every entity of any source in every year, with a presence flag of the main table."""
    keys = reduce(lambda a, b: a.unionByName(b), [s.select(key) for s in sources]).distinct()
    grid = keys.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(presence.withColumn("_here", F.lit(True)), [key, "year"], "left").withColumn(
        "has_data", F.col("_here").isNotNull()
    ).drop("_here")


def expand_tokens(claims: DataFrame, text: str) -> DataFrame:
    """Listed code tokens to prefixes: plain codes, runs over the last digit, footnote stars."""
    token = F.rtrim(F.trim(F.col("_tok")), F.lit("* "))
    base = F.regexp_extract(token, r"^(\d+)-(\d)$", 1)
    end = F.regexp_extract(token, r"^(\d+)-(\d)$", 2)
    stem = F.expr("substring(_base, 1, length(_base) - 1)")
    lo, hi = F.right("_base", F.lit(1)).try_cast("int"), F.col("_end").try_cast("int")
    run = F.when(hi < lo, F.array(F.col("_base"))).otherwise(
        F.transform(F.sequence(lo, hi), lambda d: F.concat(stem, d.cast("string")))
    )
    prefixes = F.when(F.col("_base") != "", run).when(
        F.col("_tok").rlike(r"^\d+$"), F.array(F.col("_tok"))
    )
    return (
        claims.withColumn("_tok", F.explode(F.split(text, "[,;]")))
        .withColumn("_tok", token)
        .withColumns({"_base": base, "_end": end})
        .withColumn("prefix", F.explode(prefixes))
        .drop("_tok", "_base", "_end")
    )


def prefix_map(
    codes: DataFrame, code: str, claims: DataFrame, target: str, shortest: int = 2
) -> DataFrame:
    """Longest-prefix match; equal-depth claims by different targets stay unassigned.

    `claims` is (prefix, target). Codes are matched once each, by equi-join on their prefixes.
    """
    each = codes.select(code).where(F.col(code).isNotNull()).distinct()
    cut = each.withColumn(
        "depth", F.explode(F.sequence(F.lit(shortest), F.greatest(F.length(code), F.lit(shortest))))
    ).withColumn("prefix", F.expr(f"substring({code}, 1, depth)"))
    hits = (
        cut.join(claims.select("prefix", target).distinct(), "prefix")
        .groupBy(code, "depth")
        .agg(F.count_distinct(target).alias("n"), F.min(target).alias("t"))
        .groupBy(code)
        .agg(F.max("depth").alias("match_depth"), F.max_by(F.struct("n", "t"), "depth").alias("_b"))
    )
    status = (
        F.when(F.col("match_depth").isNull(), "unmapped")
        .when(F.col("_b.n") > 1, "ambiguous")
        .otherwise("mapped")
    )
    return join_null_safe(each, hits, [code]).select(
        code,
        F.when(F.col("_b.n") == 1, F.col("_b.t")).alias(target),
        "match_depth",
        status.alias("match_status"),
    )


def apply_concordance(
    panel: DataFrame, links: DataFrame, code: str, values: Sequence[str]
) -> DataFrame:
    """Re-express a panel on successor codes, splitting values by link weight.

    Codes without a link keep weight one and are marked unresolved.
    """
    joined = panel.join(
        links.select(F.col("from_code").alias(code), "to_code", "weight", "mapping_type"),
        code,
        "left",
    ).withColumns(
        {
            "concordance_weight": F.coalesce("weight", F.lit(1.0)),
            "concordance_mapping_type": F.coalesce("mapping_type", F.lit("UNRESOLVED")),
            code: F.coalesce("to_code", F.col(code)),
        }
    )
    scaled = {v: F.col(v) * F.col("concordance_weight") for v in values}
    return joined.withColumns(scaled).drop("to_code", "weight", "mapping_type")


def classify_links(links: DataFrame) -> DataFrame:
    """Mapping type of every link from the degrees of both its ends."""
    keys_out = ["from_code", "from_vintage", "to_vintage"]
    keys_in = ["to_code", "to_vintage", "from_vintage"]
    out = links.groupBy(*keys_out).agg(F.count(F.lit(1)).alias("_out"))
    in_ = links.groupBy(*keys_in).agg(F.count(F.lit(1)).alias("_in"))
    joined = links.join(out, keys_out).join(in_, keys_in)
    o, i = F.col("_out") > 1, F.col("_in") > 1
    kind = (
        F.when(o & i, "MANY_TO_MANY")
        .when(o, "ONE_TO_MANY")
        .when(i, "MANY_TO_ONE")
        .otherwise("ONE_TO_ONE")
    )
    return joined.withColumn("mapping_type", kind).drop("_out", "_in")


def link_report(classified: DataFrame) -> DataFrame:
    stable = (
        (F.col("mapping_type") == "ONE_TO_ONE")
        & (F.col("from_code") == F.col("to_code"))
        & (F.abs(F.col("weight") - 1.0) <= 1e-9)
    )
    return classified.groupBy("mapping_type").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(stable).alias("n_stable_codes")
    )


def split_mapped(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Keys of the data with a mapping, without one, and mapping keys never used."""
    data = df.select(key).distinct()
    table = mapping.select(key).distinct()
    return (
        data.join(table, key, "left_semi")
        .withColumn("kind", F.lit("mapped"))
        .unionByName(data.join(table, key, "left_anti").withColumn("kind", F.lit("unmapped")))
        .unionByName(table.join(data, key, "left_anti").withColumn("kind", F.lit("orphan")))
    )


def check_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Overlap of two key sets, as one row."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    return left.join(right, key, "full").agg(
        F.count("_a").alias("left_keys"),
        F.count("_b").alias("right_keys"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("shared_keys"),
        F.when(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)) == 0, "disjoint")
        .when(F.count("_a") == F.count(F.when(F.col("_b").isNotNull(), F.col("_a"))), "covered")
        .otherwise("partial")
        .alias("verdict"),
    )


def guard_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Fail before a join whose sides share no key at all."""
    if check_keys(a, b, key).first()["verdict"] == "disjoint":
        raise ValueError(f"no value of {key} is shared; the two sources use different codes")


def to_parent(df: DataFrame, codes: str, delineation: DataFrame, vintage: str) -> DataFrame:
    """Codes to the parent area under one vintage; codes it does not list stay null."""
    table = delineation.where(F.col("vintage") == vintage).select(
        F.col("child").alias(codes), F.col("parent").alias("parent_area")
    )
    return df.join(table, codes, "left")


def code_stability(members: DataFrame) -> DataFrame:
    """Verdict on a code from its member sets across vintages.

    `members` is (vintage, code, member). A set is known by a digest that partial aggregates merge:
    the number of its distinct members and two 64-bit combinations of their hashes.
    """
    sets = (
        members.select("vintage", "code", "member")
        .distinct()
        .groupBy("code", "vintage")
        .agg(
            F.struct(
                F.count(F.lit(1)),
                F.bit_xor(F.xxhash64(F.lit(1), "member")),
                F.sum(F.xxhash64(F.lit(2), "member").cast("decimal(20,0)")),
            ).alias("members"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    vintages = total(members, F.count_distinct("vintage"))
    verdict = (
        F.when(F.col("vintages_present") < vintages, "not_in_all_vintages")
        .when(F.col("distinct_sets") == 1, "stable")
        .when(F.col("lo") == F.col("hi"), "composition_changed")
        .otherwise("membership_count_changed")
    )
    return (
        sets.groupBy("code")
        .agg(
            F.count(F.lit(1)).alias("vintages_present"),
            F.count_distinct("members").alias("distinct_sets"),
            F.min("n").alias("lo"),
            F.max("n").alias("hi"),
        )
        .withColumn("verdict", verdict)
        .drop("lo", "hi")
    )


def stack_mappings(vintages: DataFrame, primary: int) -> DataFrame:
    """One mapping from yearly vintages: primary first, then the earliest that has the code.

    Targets absent from the latest vintage are retired; where that vintage maps the same code,
    its target replaces them. A code the primary maps differently from a later year is flagged.
    """
    order = F.struct((F.col("year") != primary).alias("later"), F.col("year"))
    chosen = vintages.groupBy("code").agg(
        F.min_by(F.struct("target", "year"), order).alias("_pick"),
        F.min(F.when(F.col("year") == primary, F.col("target"))).alias("_primary"),
    )
    newest = vintages.where(F.col("year") == total(vintages, F.max("year")))
    live = newest.select("target").distinct()
    successor = newest.select("code", F.col("target").alias("_successor"))
    moved = (
        vintages.where(F.col("year") != primary)
        .join(chosen.select("code", "_primary"), "code")
        .where(F.col("_primary").isNotNull() & (F.col("target") != F.col("_primary")))
        .select("code")
        .distinct()
        .withColumn("reclassified", F.lit(True))
    )
    picked = chosen.select(
        "code", F.col("_pick.target").alias("target"), F.col("_pick.year").alias("vintage_year")
    )
    retired = picked.join(live, "target", "left_anti").select("code").withColumn("_old", F.lit(True))
    out = (
        picked.join(retired, "code", "left")
        .join(successor, "code", "left")
        .join(moved, "code", "left")
    )
    repair = F.col("_old").isNotNull() & F.col("_successor").isNotNull()
    return out.select(
        "code",
        F.when(repair, F.col("_successor")).otherwise(F.col("target")).alias("target"),
        "vintage_year",
        (F.col("vintage_year") == primary).alias("from_primary"),
        repair.alias("repaired"),
        F.coalesce("reclassified", F.lit(False)).alias("reclassified"),
    )


def merge_strict(maps: Sequence[DataFrame], key: Sequence[str], value: str) -> DataFrame:
    """Union of evidence maps; a key with two different values is an error."""
    merged = reduce(lambda a, b: a.unionByName(b), [m.select(*key, value) for m in maps])
    facts = merged.groupBy(*key).agg(
        F.min(value).alias(value), F.max(value).alias("_other"), F.count(F.lit(1)).alias("n_sources")
    )
    require_none(facts, F.col(value) != F.col("_other"), "sources disagree on a shared key")
    return facts.drop("_other")


# --- panel assembly ---------------------------------------------------------------


def monthly_panel(
    stock: DataFrame, index: DataFrame, permits: DataFrame, unemployment: DataFrame
) -> DataFrame:
    """Monthly stock with the area's index and its growth, permits and unemployment."""
    for other in (index, permits, unemployment):
        guard_keys(stock, other, "geography")
    growth = safe_log("hpi") - F.lag(safe_log("hpi"), 12).over(ordered(["geography"], "period"))
    keys = ["geography", "period"]
    return (
        stock.join(index.withColumn("hpi_growth_12m", growth), keys, "left")
        .join(permits, keys, "left")
        .join(unemployment, keys, "left")
    )


def local_panel(
    stock: DataFrame,
    index: DataFrame,
    permits: DataFrame,
    unemployment: DataFrame,
    first: int,
    last: int,
) -> DataFrame:
    """Annual market panel: the skeleton of all areas and years, then each block at its span.

    Flows of years without twelve observed months are left missing, never understated.
    """
    year = F.year("period").alias("year")
    keys = ["geography", "year"]
    yearly_stock = stock.groupBy("geography", year).agg(
        F.avg("n_active_loans").alias("mean_active_loans"),
        F.avg("wavg_note_rate_upb").alias("wavg_note_rate_upb"),
        F.sum("n_prepayments").alias("n_prepayments"),
    )
    growth = safe_log("hpi") - F.lag(safe_log("hpi"), 12).over(ordered(["geography"], "period"))
    yearly_index = (
        index.withColumn("_g", growth)
        .groupBy("geography", year)
        .agg(
            F.min_by("hpi", "period").alias("hpi_year_start"),
            F.max_by("hpi", "period").alias("hpi_year_end"),
            F.max_by(F.struct("_g"), "period").getField("_g").alias("hpi_growth_12m_dec"),
        )
    )

    def complete(df: DataFrame, out: Column) -> DataFrame:
        return (
            df.groupBy("geography", year)
            .agg(out, F.count(F.lit(1)).alias("_n"))
            .where("_n = 12")
            .drop("_n")
        )

    yearly_permits = complete(permits, F.sum("permits").alias("permits"))
    yearly_unemployment = complete(
        unemployment, F.avg("unemployment_rate").alias("unemployment_rate")
    )
    base = skeleton(
        [stock, index], "geography", first, last, yearly_stock.select(*keys)
    ).withColumnRenamed("has_data", "has_stock_data")
    out = (
        base.join(yearly_stock, keys, "left")
        .join(yearly_index, keys, "left")
        .join(yearly_permits, keys, "left")
        .join(yearly_unemployment, keys, "left")
    )
    return out.withColumns({"log_permits": safe_log("permits"), "log_hpi": safe_log("hpi_year_end")})


def application_counts(rows: DataFrame) -> DataFrame:
    """Loan applications per area and year: originations by purpose, and purchase denials.

    `rows` has geography, year, purpose (purchase or refinance) and action (originated, denied or
    another). Decided purchase applications are the base of a denial rate.
    """
    purpose, action = F.col("purpose"), F.col("action")
    made, refused = action == "originated", action == "denied"
    purchase = purpose == "purchase"
    return rows.groupBy("geography", "year").agg(
        F.count_if(purchase & made).alias("n_purchase_originations"),
        F.count_if((purpose == "refinance") & made).alias("n_refi_originations"),
        F.count_if(purchase & (made | refused)).alias("n_purchase_applications"),
        F.count_if(purchase & refused).alias("n_purchase_denials"),
    )


def positive_log(c: str) -> Column:
    """Log of a count; null at zero, as a zero has no log and must not become one."""
    return F.when(F.col(c) > 0, F.ln(F.col(c).cast("double")))


def market_outcomes(
    panel: DataFrame,
    applications: DataFrame | None = None,
    exposure: DataFrame | None = None,
    index: DataFrame | None = None,
    fixed: DataFrame | None = None,
    growth_span: tuple[str, str] | None = None,
    refi_years: tuple[int, int] | None = None,
) -> DataFrame:
    """Adds outcomes and predetermined covariates to an annual panel.

    Outcomes: originations in logs, denial rate and within-year index growth. Covariates, one value
    per area and so never recomputed over time: `exposure` under a pre_ prefix, `fixed` shares, the
    index's growth over `growth_span` (first and last month) and refinance originations summed over
    `refi_years`. A source may be missing; its columns then are. Keys of every source are checked
    against the panel's before it is joined.
    """
    keys = ["geography", "year"]
    out = panel
    for other in (applications, exposure, index, fixed):
        if other is not None:
            guard_keys(panel, other, "geography")
    if applications is not None:
        out = out.join(applications, keys, "left").withColumns(
            {
                "log_purchase_originations": positive_log("n_purchase_originations"),
                "log_refi_originations": positive_log("n_refi_originations"),
                "denial_rate": ratio(F.col("n_purchase_denials"), F.col("n_purchase_applications")),
            }
        )
        if refi_years is not None:
            before = applications.where(F.col("year").between(*refi_years))
            out = out.join(
                before.groupBy("geography").agg(F.sum("n_refi_originations").alias("pre_refi_count")),
                "geography",
                "left",
            )
    if {"hpi_year_start", "hpi_year_end"} <= set(panel.columns):
        out = out.withColumn("hpi_growth", positive_log("hpi_year_end") - positive_log("hpi_year_start"))
    if exposure is not None:
        renamed = {c: f"pre_{c}" for c in exposure.columns if c != "geography"}
        out = out.join(exposure.withColumnsRenamed(renamed), "geography", "left")
    if index is not None and growth_span is not None:
        inside = F.col("period").between(*[F.lit(d).cast("date") for d in growth_span])
        growth = index.where(inside).groupBy("geography").agg(
            F.ln(F.max_by("hpi", "period")).alias("_end"), F.ln(F.min_by("hpi", "period")).alias("_start")
        )
        out = out.join(
            growth.select("geography", (F.col("_end") - F.col("_start")).alias("pre_hpi_growth")),
            "geography",
            "left",
        )
    if fixed is not None:
        out = out.join(fixed, "geography", "left")
    return out
