"""The last release before a target that changed a feature, for all targets and features at once.

A feature reads the newest cells of its series that had been released. Which cell follows which when
releases come in does not depend on the target: before cell d was released, the newest cell up to it
was the newest earlier one released before d. So each cell is linked once to the one it took over
from and carries the last change up to its own release; a target only looks up its newest cell and
that cell's last revision. Ragged-edge features, whose cells end at the moment itself, have one path
of values for all targets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymetrics.core import asof_backward, newest_before, ordered
from quaymetrics.functions.columns import transform
from quaymetrics.operators import vintage as VT
from quaymetrics.session import forget, stored

TICK = "interval 0.000001 seconds"
CELL = ["feature_name", "observation_date"]
CHANGE = "struct<t:timestamp_ntz,a:double,b:double>"


def differs(a: Column, b: Column) -> Column:
    return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > 1e-12, F.lit(False))


def _transformed(current: Column, previous: Column, specs: Sequence[VT.FeatureSpec]) -> Column:
    kinds = sorted({s.transformation for s in specs})
    return reduce(
        lambda acc, k: acc.when(F.col("transformation") == k, transform(current, previous, k)), kinds, F
    )


def _with_specs(df: DataFrame, specs: Sequence[VT.FeatureSpec]) -> DataFrame:
    """Rows of each feature's series, once per feature."""
    return VT._spec_rows(df.withColumnRenamed("series_id", "_series"), specs).where(
        F.col("_series") == F.col("series_id")
    )


def _linked_cells(
    versions: DataFrame, specs: Sequence[VT.FeatureSpec]
) -> tuple[DataFrame, DataFrame]:
    """(states, revisions) of features whose cells end at a period before the target.

    A state is the feature's value at a cell from a moment on; a revision is a later change of it.
    """
    t = F.col(VT.AVAILABLE)
    gap = F.when(F.col("frequency") == "quarterly", 3).otherwise(1)
    named = _with_specs(versions, specs)
    own = named.select(
        "feature_name", "transformation", "observation_date", t.alias("t"), F.struct("value").alias("own")
    )
    older = named.select(
        "feature_name",
        "transformation",
        F.add_months("observation_date", gap).alias("observation_date"),
        t.alias("t"),
        F.struct("value").alias("older"),
    )
    moments = (
        own.unionByName(older, allowMissingColumns=True)
        .groupBy(*CELL, "transformation", "t")
        .agg(F.max("own").alias("own"), F.max("older").alias("older"))
    )
    so_far = ordered(CELL, "t").rowsBetween(Window.unboundedPreceding, 0)
    path = moments.withColumns(
        {c: F.last(c, ignorenulls=True).over(so_far) for c in ("own", "older")}
    ).where(F.col("own").isNotNull())
    value = _transformed(F.col("own.value"), F.col("older.value"), specs)
    before = F.lag("f").over(ordered(CELL, "t"))
    states = path.select(*CELL, "t", value.alias("f")).withColumns(
        {"_before": before, "_nth": F.row_number().over(ordered(CELL, "t"))}
    )
    revisions = states.where((F.col("_nth") > 1) & differs(F.col("f"), F.col("_before"))).select(
        *CELL, "t", F.struct("t", F.col("_before").alias("a"), F.col("f").alias("b")).alias("change")
    )
    return states.select(*CELL, "t", F.struct("f").alias("state")), revisions


def _settled(links: DataFrame) -> DataFrame:
    """Follows links to earlier cells until each cell has its last change, or none is left.

    Every round doubles the length of the links, so a series that never changes takes as many
    rounds as its length has binary digits.
    """
    open_ = F.col("change").isNull() & F.col("link").isNotNull()
    while not links.where(open_).isEmpty():
        onward = links.select(
            "feature_name",
            F.col("observation_date").alias("link"),
            F.col("change").alias("_change"),
            F.col("link").alias("_link"),
        )
        new = stored(
            links.join(onward, ["feature_name", "link"], "left").select(
                *CELL,
                F.coalesce("change", "_change").alias("change"),
                F.when(F.col("change").isNull() & F.col("_change").isNull(), F.col("_link")).alias("link"),
            ),
            "links",
        )
        forget(links)
        links = new
    return links


def _by_target_period(
    versions: DataFrame, cells: DataFrame, targets: DataFrame, specs: Sequence[VT.FeatureSpec]
) -> DataFrame:
    states, revisions = _linked_cells(versions, specs)
    dates = cells.select("series_id", F.col("place"), F.col("observation_date"))
    mine = _with_specs(cells, specs).select("feature_name", "series_id", "observation_date", "place", "start")
    # the cell that each cell took over from
    points = cells.select(
        "series_id", (F.col("place") - 1).alias("upto"), F.col("start").alias("before"), "place"
    )
    starts = cells.select("series_id", "place", "start")
    taken = newest_before(points, starts, ["series_id"])
    # the cell each target ends with
    wanted = (
        VT._spec_rows(targets.withColumn("as_of_timestamp", F.col("release_timestamp")), specs)
        .withColumn("limit", VT._period_cutoff())
        .select("forecast_id", "feature_name", "series_id", "limit", F.col("release_timestamp").alias("before"))
    )
    last = dates.withColumnRenamed("place", "upto")
    wanted = asof_backward(wanted, last, "limit", "observation_date", ["upto"], ["series_id"])
    ends = newest_before(wanted, starts, ["series_id"])

    def dated(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.get("found", F.lit(0))).join(dates, ["series_id", "place"]).drop(
            "place", "found"
        )

    came = (
        mine.withColumns({"upto": F.col("place") - 1, "before": F.col("start")})
        .join(dated(taken).withColumnRenamed("observation_date", "link"), ["series_id", "upto", "before"], "left")
        .select(*CELL, "link", "start")
    )
    # two as-of joins look at the earlier cell one tick before the take-over
    asked = came.select(
        "feature_name",
        F.col("link").alias("observation_date"),
        F.col("observation_date").alias("_next"),
        (F.col("start") - F.expr(TICK)).alias("_at"),
    ).where(F.col("observation_date").isNotNull())
    seen = asof_backward(asked, revisions, "_at", "t", ["change"], CELL)
    seen = asof_backward(seen, states, "_at", "t", ["state"], CELL).select(
        "feature_name",
        F.col("_next").alias("observation_date"),
        F.col("change").alias("_revised"),
        F.col("state.f").alias("_from"),
    )
    first = states.groupBy(*CELL).agg(F.min_by("state", "t").alias("_first"))
    entry = F.when(
        differs(F.col("_first.f"), F.col("_from")),
        F.struct(F.col("start").alias("t"), F.col("_from").alias("a"), F.col("_first.f").alias("b")),
    )
    links = stored(
        came.join(first, CELL)
        .join(seen, CELL, "left")
        .select(*CELL, F.coalesce(entry, "_revised").cast(CHANGE).alias("change"), "link"),
        "links",
    )
    settled = _settled(links).select(*CELL, F.col("change").alias("_entered"))
    jobs = wanted.join(dated(ends), ["series_id", "upto", "before"]).withColumn(
        "_at", F.col("before") - F.expr(TICK)
    )
    hit = asof_backward(jobs, revisions, "_at", "t", ["change"], CELL).join(settled, CELL, "left")
    return hit.select("forecast_id", "feature_name", F.coalesce("change", "_entered").alias("change"))


def _ragged(
    versions: DataFrame, cells: DataFrame, targets: DataFrame, specs: Sequence[VT.FeatureSpec]
) -> DataFrame:
    """Features that read the newest cells up to the moment: their values around each release."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), (F.col("t") - F.expr(TICK) * (1 - k)).alias("at")) for k in (0, 1)]))
    moments = (
        versions.select("series_id", F.col(VT.AVAILABLE).alias("t"))
        .distinct()
        .withColumn("_s", sides)
        .select("series_id", "t", F.col("_s.side").alias("side"), F.col("_s.at").alias("at"))
        .withColumns({"limit": F.to_date("at"), "before": F.col("at") + F.expr(TICK)})
    )
    depth = max([2, *[s.window or 1 for s in specs]])
    upto = cells.select("series_id", "observation_date", F.col("place").alias("upto"))
    placed = asof_backward(moments, upto, "limit", "observation_date", ["upto"], ["series_id"])
    starts = cells.select("series_id", "place", "start")
    found = newest_before(placed, starts, ["series_id"], depth)
    rows = (
        placed.join(found, ["series_id", "upto", "before"], "left")
        .select("series_id", "t", "side", "at", F.posexplode_outer("found").alias("_nth", "place"))
        .join(cells.select("series_id", "place", "observation_date"), ["series_id", "place"], "left")
    )
    marks = versions.select("series_id", "observation_date", VT.AVAILABLE, "value")
    values = asof_backward(rows, marks, "at", VT.AVAILABLE, ["value"], ["series_id", "observation_date"])
    named = _with_specs(values, specs)
    trailing = F.col("aggregation") == "trailing_mean"

    used = (F.col("_nth") < F.col("window_rows")) & F.col("value").isNotNull()

    def nth(k: int) -> Column:
        return F.max(F.when(F.col("_nth") == k, F.col("value")))

    facts = named.groupBy("feature_name", "transformation", "aggregation", "t", "side").agg(
        nth(0).alias("_cur"),
        nth(1).alias("_prev"),
        F.sort_array(F.collect_list(F.when(used, F.struct("_nth", "value")))).alias("_window"),
    )
    # summed in a fixed order: the last bits must not tell two equal windows apart
    total = F.aggregate("_window", F.lit(0.0), lambda s, e: s + e["value"])
    facts = facts.withColumn("_mean", F.when(F.size("_window") > 0, total / F.size("_window")))
    value = F.when(trailing, F.col("_mean")).otherwise(_transformed(F.col("_cur"), F.col("_prev"), specs))
    facts = facts.withColumn("f", value)
    around = facts.groupBy("feature_name", "t").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("f"))).alias("b"),
    )
    changes = around.where(differs(F.col("a"), F.col("b"))).select(
        "feature_name", "t", F.struct("t", "a", "b").alias("change")
    )
    wanted = VT._spec_rows(targets, specs).select(
        "forecast_id", "feature_name", (F.col("release_timestamp") - F.expr(TICK)).alias("_at")
    )
    return asof_backward(wanted, changes, "_at", "t", ["change"], ["feature_name"]).select(
        "forecast_id", "feature_name", "change"
    )


def last_update(
    vintages: DataFrame, targets: DataFrame, specs: Sequence[VT.FeatureSpec]
) -> DataFrame:
    """Latest release before each target's own that changed each feature, with both values.

    `targets` has forecast_id, target_period, target_frequency and release_timestamp. Features that
    no release changed before a target have no row.
    """
    versions = VT._one_per_instant(vintages)
    used = sorted({s.series_id for s in specs})
    versions = stored(versions.where(F.col("series_id").isin(used)), "versions")
    cells = stored(
        VT.ranked_cells(
            versions.groupBy(*VT.CELL).agg(F.min(VT.AVAILABLE).alias("start"))
        ),
        "cells",
    )
    parts = []
    native = [s for s in specs if s.frequency in ("monthly", "quarterly")]
    ragged = [s for s in specs if s.frequency not in ("monthly", "quarterly")]
    if native:
        parts.append(_by_target_period(versions, cells, targets, native))
    if ragged:
        parts.append(_ragged(versions, cells, targets, ragged))
    found = reduce(lambda a, b: a.unionByName(b), parts).where(F.col("change").isNotNull())
    return found.select(
        "forecast_id",
        "feature_name",
        F.col("change.t").alias("release_timestamp"),
        F.col("change.a").alias("previous_value"),
        F.col("change.b").alias("updated_value"),
    )


def update_event(updates: DataFrame, targets: DataFrame, specs: Sequence[VT.FeatureSpec]) -> DataFrame:
    """The one release to report per target: of other series before the target's own, of monthly and
    quarterly ones before weekly before others, then the latest; with the features it changed."""
    named = F.create_map(*[x for s in specs for x in (F.lit(s.name), F.struct(F.lit(s.series_id), F.lit(s.frequency)))])
    spec = named[F.col("feature_name")]
    rank = (
        F.when(spec["col2"].isin("monthly", "quarterly"), 0).when(spec["col2"] == "weekly", 1).otherwise(2)
    )
    rows = updates.join(targets.select("forecast_id", "target_series_id"), "forecast_id").select(
        "forecast_id",
        "feature_name",
        F.struct(
            (spec["col1"] == F.col("target_series_id")).cast("int").alias("own"),
            rank.alias("rank"),
            (-F.unix_micros(F.col("release_timestamp").cast("timestamp"))).alias("t"),
        ).alias("order"),
        spec["col1"].alias("series_id"),
        "release_timestamp",
    )
    best = rows.groupBy("forecast_id").agg(F.min("order").alias("_best"))
    return (
        rows.join(best, "forecast_id")
        .where(F.col("order") == F.col("_best"))
        .groupBy("forecast_id", "release_timestamp")
        .agg(F.count("*").alias("changed_features"), F.min("feature_name").alias("first_feature"))
    )
