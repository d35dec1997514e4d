"""Trip logs to zone-time panels, origin-destination flows, graphs and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import (
    count_where,
    join_null_safe,
    ordered,
    quantiles,
    ratio,
    scalars,
    share,
    table_quantiles,
    time_bin,
    total,
)
from quaymetrics.functions.columns import calendar_parts, iso_weekday
from quaymetrics.operators.sets import union_all, union_distinct
from quaymetrics.operators.trips import CLEAN_TRIP, UNKNOWN_ZONE, ensure_columns
from quaymetrics.session import stored

PANEL_KEYS = ("source", "zone_type", "zone_id", "time_bin")
PANEL_ZEROS = (
    "trip_count",
    "distinct_dropoff_zones",
    "outbound_trip_count",
    "od_pair_observed_count",
    "total_fare",
    "total_trip_miles",
)


def _zone(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(UNKNOWN_ZONE))


def zone_time_panel(trips: DataFrame, minutes: int = 15, complete: bool = False) -> DataFrame:
    """Pickup zone x local time cells.

    A total over only unknown fares stays unknown. Destination measures are null where no
    origin-destination pair of the cell is known. Medians keep one counter per distinct fare,
    and fares are quoted in cents, so a busy cell's buffer stays small.
    """
    df = ensure_columns(trips, CLEAN_TRIP).where(F.col("pickup_datetime").isNotNull())
    known = F.col("pickup_zone_id").isNotNull() & F.col("dropoff_zone_id").isNotNull()
    df = df.select(
        "source",
        "zone_type",
        _zone("pickup_zone_id").alias("zone_id"),
        time_bin("pickup_datetime", minutes).alias("time_bin"),
        known.alias("_od"),
        F.when(known, F.col("dropoff_zone_id")).alias("_to"),
        F.when(known, F.col("pickup_zone_id") == F.col("dropoff_zone_id")).alias("_intra"),
        "fare",
        "trip_seconds",
        "trip_miles",
        "shared_requested",
        "shared_matched",
        "airport_trip",
        "pickup_census_tract_missing_or_suppressed",
        F.col("reported_timestamp_rounding_minutes").isNotNull().alias("_ts_rounded"),
        F.col("reported_fare_rounding_increment").isNotNull().alias("_fare_rounded"),
    )
    any_od = F.count_if("_od") > 0
    panel = df.groupBy(*PANEL_KEYS).agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.when(any_od, F.count_distinct("_to")).alias("distinct_dropoff_zones"),
        F.when(any_od, F.count_if(~F.col("_intra"))).alias("outbound_trip_count"),
        share(F.col("_intra")).alias("intra_zone_share"),
        F.count_if("_od").alias("od_pair_observed_count"),
        share(F.col("_od")).alias("od_pair_observed_share"),
        F.avg("fare").alias("avg_fare"),
        F.median("fare").alias("median_fare"),
        F.sum("fare").alias("total_fare"),
        F.avg("trip_seconds").alias("avg_trip_seconds"),
        F.avg("trip_miles").alias("avg_trip_miles"),
        F.sum("trip_miles").alias("total_trip_miles"),
        share(F.col("shared_requested")).alias("shared_requested_share"),
        share(F.col("shared_matched")).alias("shared_matched_share"),
        share(F.col("airport_trip")).alias("airport_trip_share"),
        share(F.col("pickup_census_tract_missing_or_suppressed")).alias(
            "pickup_geography_missing_or_suppressed_share"
        ),
        share(F.col("_ts_rounded")).alias("timestamp_rounded_measurement_share"),
        share(F.col("_fare_rounded")).alias("fare_rounded_measurement_share"),
    )
    panel = complete_grid(panel, minutes) if complete else panel
    return with_calendar(panel, minutes)


def with_calendar(panel: DataFrame, minutes: int) -> DataFrame:
    grain = f"{minutes // 60}h" if minutes % 60 == 0 else f"{minutes}m"
    return panel.withColumns(
        {**calendar_parts("time_bin"), "panel_grain": F.lit(f"pickup_zone_x_{grain}")}
    )


def complete_grid(
    panel: DataFrame, minutes: int, zeros: Sequence[str] = PANEL_ZEROS
) -> DataFrame:
    """Every zone in every bin between the first and last bin of its source.

    Made cells are known zero-trip cells; a null inside an observed cell stays null. The grid
    is exploded per zone from the source's time span.
    """
    span = panel.groupBy("source", "zone_type").agg(
        F.min("time_bin").alias("_lo"), F.max("time_bin").alias("_hi")
    )
    zones = panel.select("source", "zone_type", "zone_id").distinct()
    step = F.expr(f"interval {minutes} minutes")
    grid = zones.join(span, ["source", "zone_type"]).select(
        "source",
        "zone_type",
        "zone_id",
        F.explode(F.sequence("_lo", "_hi", step)).alias("time_bin"),
    )
    cells = grid.join(panel.withColumn("_seen", F.lit(True)), list(PANEL_KEYS), "left")
    made = F.col("_seen").isNull()
    filled = {
        c: F.when(made, F.lit(0)).otherwise(F.col(c)) for c in zeros if c in panel.columns
    }
    return cells.withColumns(filled).drop("_seen")


def od_flow(trips: DataFrame, minutes: int = 15) -> DataFrame:
    """Origin x destination x time flows."""
    df = ensure_columns(trips, CLEAN_TRIP).where(F.col("pickup_datetime").isNotNull())
    flows = df.groupBy(
        "source",
        "zone_type",
        _zone("pickup_zone_id").alias("origin_zone_id"),
        _zone("dropoff_zone_id").alias("destination_zone_id"),
        time_bin("pickup_datetime", minutes).alias("time_bin"),
    ).agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.avg("fare").alias("avg_fare"),
        F.avg("trip_miles").alias("avg_trip_miles"),
    )
    t = F.col("time_bin")
    return flows.withColumns(
        {"service_date": F.to_date(t), "year": F.year(t), "month": F.month(t)}
    )


def trip_moments(
    df: DataFrame, wait: str, fare: str, pay: str, approximate: bool = False
) -> DataFrame:
    """Moments of waiting time, fare and pay, their correlation and ratio, in one pass.

    Quantiles are exact by default, by two more passes that move only bucket counts and the buckets
    that hold a wanted position; the three columns are written once for these, so that what makes
    them, joins as a rule, runs once. The approximate variant stays in the same pass and uses the built-in
    sketch, whose rank error is at most 1 / 10,000 of the rows.
    """
    w, f, p = F.col(wait), F.col(fare), F.col(pay)
    valid = F.when(w >= 0, w)
    if not approximate:
        df = stored(df.select(wait, fare, pay), "moments")
    out = df.agg(
        F.count(F.lit(1)).alias("trip_rows"),
        F.count(w).alias("wait_published_rows"),
        F.count(valid).alias("wait_valid_rows"),
        count_where(w < 0).alias("wait_negative_rows"),
        count_where(w == 0).alias("wait_zero_rows"),
        F.avg(valid).alias("wait_mean"),
        F.stddev_pop(valid).alias("wait_stddev"),
        F.min(valid).alias("wait_min"),
        F.max(valid).alias("wait_max"),
        *[
            e
            for name, c in (("fare", f), ("pay", p))
            for e in (
                F.count(c).alias(f"{name}_known_rows"),
                count_where(c < 0).alias(f"{name}_negative_rows"),
                count_where(c == 0).alias(f"{name}_zero_rows"),
                F.sum(c).alias(f"{name}_sum"),
                F.avg(c).alias(f"{name}_mean"),
                F.stddev_pop(c).alias(f"{name}_stddev"),
                F.min(c).alias(f"{name}_min"),
                F.max(c).alias(f"{name}_max"),
            )
        ],
        F.corr(f, p).alias("fare_pay_correlation"),
        ratio(F.sum(p), F.sum(f)).alias("pay_to_fare_ratio"),
    )
    wanted = [
        ("wait", valid, (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)),
        ("fare", f, (0.1, 0.5, 0.9, 0.99)),
        ("pay", p, (0.1, 0.5, 0.9, 0.99)),
    ]
    named = [(name, c, f"p{int(q * 100)}", q) for name, c, probs in wanted for q in probs]
    if approximate:
        part = df.agg(*[F.percentile_approx(c, q, 10000).alias(f"{m}_{n}") for m, c, n, q in named])
    else:
        found = table_quantiles(df, {m: (c, {n: q for k, _, n, q in named if k == m}) for m, c, _ in wanted})
        values = {f"{m}_{n}": F.lit(v).cast("double") for m, of in found.items() for n, v in of.items()}
        return out.withColumns({f"{m}_{n}": values[f"{m}_{n}"] for m, _, n, _ in named})
    return out.withColumns(scalars(part))


def variance_decomposition(panel: DataFrame) -> DataFrame:
    """Population variance of cells, between and within zones and hours of the day.

    Group sums of y and y^2 give every component; no cell is joined back.
    """
    y = F.col("trip_count").cast("double")
    cells = panel.withColumn("_y", y).withColumn("_hour", F.hour("time_bin"))
    grand = cells.agg(
        F.count(F.lit(1)).alias("panel_cells"),
        F.count_distinct("zone_id").alias("zones"),
        F.count_distinct("time_bin").alias("periods"),
        F.avg("_y").alias("mean_cell"),
        F.var_pop("_y").alias("total_cell_variance"),
        count_where(F.col("_y") > 0).alias("occupied_cells"),
        F.sum("trip_count").alias("total_completed_trips"),
    )

    def parts(key: str) -> tuple[Column, Column]:
        by = cells.groupBy(key).agg(
            F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v")
        )
        n = F.col("n")
        both = by.agg(
            (F.sum(n * F.col("m") * F.col("m")) / F.sum(n)
             - (F.sum(n * F.col("m")) / F.sum(n)) * (F.sum(n * F.col("m")) / F.sum(n))).alias("b"),
            (F.sum(n * F.col("v")) / F.sum(n)).alias("w"),
        )
        found = scalars(both)
        return found["b"], found["w"]

    zb, zw = parts("zone_id")
    hb, hw = parts("_hour")
    t = F.col("total_cell_variance")
    return grand.withColumns({"_zb": zb, "_zw": zw, "_hb": hb, "_hw": hw}).select(
        *grand.columns,
        F.col("_zb").alias("between_zone_component"),
        F.col("_zw").alias("within_zone_temporal_component"),
        ratio(F.col("_zb"), t).alias("icc_like_between_zone_share"),
        (F.col("_zb") + F.col("_zw") - t).alias("zone_decomposition_residual"),
        F.col("_hb").alias("between_hour_of_day_component"),
        F.col("_hw").alias("within_hour_of_day_component"),
        ratio(F.col("_hb"), t).alias("between_hour_of_day_share"),
        (F.col("_hb") + F.col("_hw") - t).alias("hour_decomposition_residual"),
    )


# --- flow graph -------------------------------------------------------------------


def od_month(od: DataFrame) -> DataFrame:
    return od.groupBy("origin_zone_id", "destination_zone_id").agg(
        F.sum("trip_count").alias("trip_count")
    )


def od_edges(flows: DataFrame) -> DataFrame:
    """Undirected cross-zone edges with the flow in each direction."""
    o, d, n = F.col("origin_zone_id"), F.col("destination_zone_id"), F.col("trip_count")
    return (
        flows.where(o != d)
        .groupBy(F.least(o, d).alias("zone_a"), F.greatest(o, d).alias("zone_b"))
        .agg(
            F.sum(n).alias("edge_weight"),
            F.sum(F.when(o < d, n).otherwise(0)).alias("trips_a_to_b"),
            F.sum(F.when(o > d, n).otherwise(0)).alias("trips_b_to_a"),
        )
    )


def graph_summary(flows: DataFrame) -> DataFrame:
    """Density, edge concentration, top-ten share and intra-zone flow of the OD graph.

    The flows, a row per pair of zones, are read several times and therefore written once.
    """
    flows = stored(flows, "flows")
    edges = stored(od_edges(flows), "edges")
    o, d, n = F.col("origin_zone_id"), F.col("destination_zone_id"), F.col("trip_count")
    totals = flows.agg(
        F.count(F.lit(1)).alias("directed_pairs"),
        F.sum(n).alias("total_trips"),
        F.coalesce(F.sum(F.when(o == d, n)), F.lit(0)).alias("intra_zone_trips"),
        F.greatest(F.count_distinct(o), F.count_distinct(d)).alias("nodes"),
    )
    w = F.col("edge_weight").cast("double")
    stats = edges.agg(
        F.count(F.lit(1)).alias("e"),
        F.sum("edge_weight").alias("c"),
        ratio(F.sum(w * w), F.sum(w) * F.sum(w)).alias("h"),
    )
    top = edges.orderBy(F.desc("edge_weight"), "zone_a", "zone_b").limit(10)
    nodes = F.col("nodes")
    found = scalars(stats)
    return totals.withColumns(
        {
            "undirected_cross_zone_edges": found["e"],
            "cross_zone_trips": found["c"],
            "edge_weight_hhi": found["h"],
            "_top": total(top, F.sum("edge_weight")),
        }
    ).withColumns(
        {
            "cross_zone_share": ratio(F.col("cross_zone_trips"), F.col("total_trips")),
            "undirected_density": ratio(
                F.col("undirected_cross_zone_edges"), nodes * (nodes - 1) / 2
            ),
            "top_10_edge_weight_share": ratio(F.col("_top"), F.col("cross_zone_trips")),
        }
    ).drop("_top")


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once per focal side."""
    w = F.col("edge_weight").cast("double").alias("weight")
    one = edges.select(
        F.col("zone_a").alias("focal_zone_id"), F.col("zone_b").alias("neighbor_zone_id"), w
    )
    two = edges.select(
        F.col("zone_b").alias("focal_zone_id"), F.col("zone_a").alias("neighbor_zone_id"), w
    )
    return union_all(one, two)


def graph_nodes(flows: DataFrame) -> DataFrame:
    return union_distinct(
        flows.select(F.col("origin_zone_id").alias("zone_id")),
        flows.select(F.col("destination_zone_id").alias("zone_id")),
    )


def node_table(flows: DataFrame) -> DataFrame:
    """Flows, degrees, strength, self-loop share and destination concentration per zone.

    The flows, a row per pair of zones, are read several times and therefore written once.
    """
    flows = stored(flows, "flows")
    o, d, n = F.col("origin_zone_id"), F.col("destination_zone_id"), F.col("trip_count")
    x = n.cast("double")
    outgoing = flows.groupBy(o.alias("zone_id")).agg(
        F.sum(n).alias("outbound_trips"),
        count_where(o != d).alias("cross_zone_out_degree"),
        ratio(F.sum(x * x), F.sum(x) * F.sum(x)).alias("outbound_destination_hhi"),
        F.sum(F.when(o == d, n)).alias("self_loop_trips"),
    )
    incoming = flows.groupBy(d.alias("zone_id")).agg(
        F.sum(n).alias("inbound_trips"), count_where(o != d).alias("cross_zone_in_degree")
    )
    strength = (
        symmetric_edges(od_edges(flows))
        .groupBy(F.col("focal_zone_id").alias("zone_id"))
        .agg(
            F.count(F.lit(1)).alias("undirected_degree"),
            F.sum("weight").cast("bigint").alias("undirected_strength"),
        )
    )
    # every cross-zone trip adds to the strength of both its zones
    all_strength = total(flows, 2 * F.sum(F.when(o != d, n)))
    table = (
        graph_nodes(flows)
        .join(outgoing, "zone_id", "left")
        .join(incoming, "zone_id", "left")
        .join(strength, "zone_id", "left")
    )
    zero = (
        "outbound_trips",
        "inbound_trips",
        "self_loop_trips",
        "cross_zone_out_degree",
        "cross_zone_in_degree",
        "undirected_degree",
        "undirected_strength",
    )
    known = F.col("outbound_trips").isNotNull()
    return (
        table.withColumn("_known", known)
        .fillna(0, list(zero))
        .withColumns(
            {
                "undirected_strength_share": ratio(F.col("undirected_strength"), all_strength),
                "outbound_self_loop_share": F.when(
                    F.col("_known"), ratio(F.col("self_loop_trips"), F.col("outbound_trips"))
                ),
            }
        )
        .drop("_known")
    )


# --- profiles and summaries -------------------------------------------------------


def hour_profile(panel: DataFrame) -> DataFrame:
    """Cells by hour of day; the percentiles are by ordered buckets, so an hour is not one task."""
    y = F.col("trip_count")
    hours = panel.withColumn("hour_of_day", F.hour("time_bin"))
    moments = hours.groupBy("hour_of_day").agg(
        F.count(F.lit(1)).alias("zone_hour_cells"),
        F.count_distinct("zone_id").alias("zones"),
        F.count_distinct(F.to_date("time_bin")).alias("dates"),
        F.sum(y).alias("completed_trips"),
        F.avg(y).alias("mean_trips_per_zone_hour"),
        F.var_pop(y).alias("cell_variance"),
        F.stddev_pop(y).alias("cell_stddev"),
    )
    found = quantiles(hours, ["hour_of_day"], y, {"cell_p50": 0.5, "cell_p90": 0.9})
    return join_null_safe(moments, found, ["hour_of_day"])


def zone_profile(panel: DataFrame) -> DataFrame:
    y = F.col("trip_count")
    everything = total(panel, F.sum(y))
    moments = panel.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("hourly_cells"),
        count_where(y > 0).alias("occupied_cells"),
        F.sum(y).alias("completed_trips"),
        F.avg(y).alias("mean_trips_per_hour"),
        F.var_pop(y).alias("temporal_variance"),
        F.stddev_pop(y).alias("temporal_stddev"),
        F.max(y).alias("hourly_max"),
    )
    found = quantiles(panel, ["zone_id"], y, {"hourly_p50": 0.5, "hourly_p90": 0.9})
    return join_null_safe(moments, found, ["zone_id"]).withColumn(
        "month_trip_share", ratio(F.col("completed_trips"), everything)
    )


def _common() -> list[Column]:
    return [
        F.avg("fare").alias("avg_fare"),
        share(F.col("shared_requested")).alias("shared_requested_share"),
    ]


def daily_summary(trips: DataFrame) -> DataFrame:
    n = total(trips, F.count(F.lit(1)))
    day = F.to_date("pickup_datetime")
    return (
        trips.groupBy(day.alias("service_date"))
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            F.count_distinct("pickup_zone_id").alias("active_zones"),
            *_common(),
        )
        .withColumns(
            {
                "iso_weekday": iso_weekday("service_date"),
                "month_share": ratio(F.col("trip_count"), n),
            }
        )
    )


def _per_date() -> list[Column]:
    dates = F.count_distinct(F.to_date("pickup_datetime"))
    return [
        F.count(F.lit(1)).alias("trip_count"),
        dates.alias("dates_observed"),
        ratio(F.count(F.lit(1)), dates).alias("mean_trips_per_date"),
        *_common(),
    ]


def hourly_summary(trips: DataFrame) -> DataFrame:
    n = total(trips, F.count(F.lit(1)))
    return (
        trips.groupBy(F.hour("pickup_datetime").alias("hour"))
        .agg(*_per_date())
        .withColumn("month_share", ratio(F.col("trip_count"), n))
    )


def weekday_summary(trips: DataFrame) -> DataFrame:
    return trips.groupBy(iso_weekday("pickup_datetime").alias("iso_weekday")).agg(*_per_date())


def zone_summary(trips: DataFrame) -> DataFrame:
    n = total(trips, F.count(F.lit(1)))
    return (
        trips.groupBy(F.col("pickup_zone_id").alias("zone_id"))
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            F.count_distinct(time_bin("pickup_datetime", 60)).alias("occupied_hours"),
            *_common(),
        )
        .withColumn("month_share", ratio(F.col("trip_count"), n))
    )


def od_month_summary(od: DataFrame) -> DataFrame:
    """Month flows with share of the origin; averages are weighted by known trips' counts."""
    n = F.col("trip_count")
    return (
        od.groupBy("origin_zone_id", "destination_zone_id")
        .agg(
            F.sum(n).alias("trip_count"),
            ratio(F.sum(F.col("avg_fare") * n), F.sum(n)).alias("avg_fare"),
            ratio(F.sum(F.col("avg_trip_miles") * n), F.sum(n)).alias("avg_trip_miles"),
        )
        .transform(with_share, ["origin_zone_id"], "trip_count", "origin_flow_share")
    )


def with_share(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of a value within keys, by aggregating and joining back rather than a window."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_whole"))
    return (
        join_null_safe(df, sums, keys)
        .withColumn(out, ratio(F.col(value), F.col("_whole")))
        .drop("_whole")
    )


def od_summary(trips: DataFrame) -> DataFrame:
    flows = trips.groupBy(
        F.col("pickup_zone_id").alias("origin_zone"),
        F.col("dropoff_zone_id").alias("destination_zone"),
    ).agg(F.count(F.lit(1)).alias("trip_count"))
    return with_share(flows, ["origin_zone"], "trip_count", "origin_flow_share")


def group_shares(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """First and last value per group and the group's share of the whole table."""
    return (
        df.groupBy(group)
        .agg(
            F.min_by(value, order).alias("first_value"),
            F.max_by(value, order).alias("last_value"),
            F.sum(value).alias("total_value"),
        )
        .withColumn("share_of_total", ratio(F.col("total_value"), total(df, F.sum(value))))
    )


def demand_by_hour(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.hour("time_bin").alias("hour_of_day")).agg(
        F.avg("trip_count").alias("mean_trip_count"),
        F.sum("trip_count").alias("total_trip_count"),
        F.count(F.lit(1)).alias("cells"),
    )


def demand_by_zone(panel: DataFrame) -> DataFrame:
    return panel.groupBy("zone_id").agg(
        F.avg("trip_count").alias("mean_trip_count"),
        F.sum("trip_count").alias("total_trip_count"),
        F.count(F.lit(1)).alias("periods_observed"),
    )


#: Zones whose pairs are correlated; the result has a row per pair, so more are an error.
MOST_ZONES = 2048
PRODUCTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def zone_products(table: pa.Table, block: int = 256) -> pa.Table:
    """Sums over one stretch of time of each pair's products, as matrix products of zone blocks."""
    names = sorted(set(table.column("zone_id").to_pylist()))
    place = {z: k for k, z in enumerate(names)}
    column = np.array([place[z] for z in table.column("zone_id").to_pylist()])
    _, row = np.unique(table.column("second").to_numpy(), return_inverse=True)
    y = np.zeros((row.max() + 1, len(names)))
    seen = np.zeros_like(y)
    y[row, column], seen[row, column] = table.column("y").to_numpy(), 1.0
    found = {c: [] for c in ("i", "j", *PRODUCTS)}
    for a in range(0, len(names), block):
        ya, sa = y[:, a : a + block], seen[:, a : a + block]
        for b in range(a, len(names), block):
            yb, sb = y[:, b : b + block], seen[:, b : b + block]
            n = sa.T @ sb
            i, j = np.nonzero(n)
            keep = i + a <= j + b
            i, j = i[keep], j[keep]
            values = (n, ya.T @ sb, sa.T @ yb, (ya * ya).T @ sb, sa.T @ (yb * yb), ya.T @ yb)
            found["i"].append(i + a)
            found["j"].append(j + b)
            for c, v in zip(PRODUCTS, values, strict=True):
                found[c].append(v[i, j])
    joined = {c: np.concatenate(v) for c, v in found.items()}
    label = pa.array(names, pa.string())
    return pa.table(
        {
            "a": label.take(pa.array(joined["i"])),
            "b": label.take(pa.array(joined["j"])),
            **{c: joined[c] for c in PRODUCTS},
        }
    )


def cross_zone_correlation(panel: DataFrame, min_periods: int = 2) -> DataFrame:
    """Correlation of demand for every pair of zones, in long form.

    Trips are first summed to one row per zone and period. Each month's zones meet in blocked
    matrix products, and only sums of products per pair leave it; the mirror rows are added to the
    finished pairs.
    """
    cells = panel.groupBy("zone_id", "time_bin").agg(
        F.sum("trip_count").cast("double").alias("y")
    )
    n_zones = panel.select("zone_id").distinct().count()
    if n_zones > MOST_ZONES:
        raise ValueError(f"{n_zones} zones; correlations are for at most {MOST_ZONES}")
    rows = cells.where(F.col("zone_id").isNotNull() & F.col("time_bin").isNotNull()).select(
        F.col("zone_id").cast("string").alias("zone_id"),
        F.trunc(F.to_date("time_bin"), "month").alias("month"),
        F.unix_timestamp(F.col("time_bin").cast("timestamp")).alias("second"),
        "y",
    )
    schema = "a string, b string, " + ", ".join(f"{c} double" for c in PRODUCTS)
    sums = (
        rows.where(F.col("y").isNotNull())
        .groupBy("month")
        .applyInArrow(lambda t: zone_products(t), schema)
        .groupBy("a", "b")
        .agg(*[F.sum(c).alias(c) for c in PRODUCTS])
    )
    n, zone = F.col("n"), panel.schema["zone_id"].dataType
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    cross = n * F.col("sxy") - F.col("sx") * F.col("sy")
    r = F.when((vx > 0) & (vy > 0), cross / F.sqrt(vx) / F.sqrt(vy))
    pairs = sums.select(
        F.col("a").cast(zone).alias("a"), F.col("b").cast(zone).alias("b"), n.alias("n"), r.alias("r")
    ).where((F.col("n") >= min_periods) & F.col("r").isNotNull())
    mirrored = F.when(
        F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("o"), F.col("b").alias("c")))
    ).otherwise(
        F.array(
            F.struct(F.col("a").alias("o"), F.col("b").alias("c")),
            F.struct(F.col("b").alias("o"), F.col("a").alias("c")),
        )
    )
    return pairs.select(F.explode(mirrored).alias("p"), "r").select(
        F.col("p.o").alias("origin_zone"),
        F.col("p.c").alias("comparison_zone"),
        F.col("r").alias("demand_correlation"),
    )


def exact_lag(
    df: DataFrame, keys: Sequence[str], time: str, step: str, columns: Mapping[str, str]
) -> DataFrame:
    """Rows with the values exactly one step earlier; gaps are never adjacent."""
    prior = df.select(
        *keys,
        (F.col(time) + F.expr(step)).alias(time),
        *[F.col(c).alias(n) for c, n in columns.items()],
    )
    return df.join(prior, [*keys, time])


def autocorrelation(panel: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Exact-lag demand correlation for several hour lags, pooled and zone-centred.

    All lags are one join: the later side is repeated per lag, not the query.
    """
    y = F.col("trip_count").cast("double")
    cells = panel.select("zone_id", "time_bin", y.alias("y"))
    means = cells.groupBy("zone_id").agg(
        F.avg("y").alias("m"), F.min("time_bin").alias("lo"), F.max("time_bin").alias("hi")
    )
    shifted = cells.select(
        "zone_id", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag_hours"),
        F.col("time_bin").alias("_t"), F.col("y").alias("prev"),
    ).withColumn(
        "time_bin",
        F.timestamp_seconds(
            F.unix_timestamp(F.col("_t").cast("timestamp")) + F.col("lag_hours") * 3600
        ).cast("timestamp_ntz"),
    ).drop("_t")
    pairs = cells.join(shifted, ["zone_id", "time_bin"]).join(
        means.select("zone_id", "m"), "zone_id"
    )
    hours = (
        F.unix_timestamp(F.col("hi").cast("timestamp"))
        - F.unix_timestamp(F.col("lo").cast("timestamp"))
    ) / 3600
    possible = (
        means.select(
            F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag_hours"), hours.alias("h")
        )
        .groupBy("lag_hours")
        .agg(
            F.sum(F.greatest(F.col("h") + 1 - F.col("lag_hours"), F.lit(0)))
            .cast("bigint")
            .alias("possible_pairs_on_hourly_span")
        )
    )
    facts = pairs.groupBy("lag_hours").agg(
        F.count(F.lit(1)).alias("exact_lag_support_pairs"),
        F.corr("y", "prev").alias("pooled_trip_count_correlation"),
        F.corr(F.col("y") - F.col("m"), F.col("prev") - F.col("m")).alias(
            "within_zone_centered_correlation"
        ),
        F.avg("y").alias("current_mean"),
        F.avg("prev").alias("lagged_mean"),
    )
    return facts.join(possible, "lag_hours").withColumn(
        "support_share",
        ratio(F.col("exact_lag_support_pairs"), F.col("possible_pairs_on_hourly_span")),
    )


def panel_moments(panel: DataFrame, minutes: int, flags: Mapping[str, str] | None = None) -> DataFrame:
    """Weighted moments of a panel, previous-cell and exact-lag correlation, group contrasts.

    `flags` maps the kind of contrast (income, weather, event) to a column: income splits at
    its median over cells, the others at zero.
    """
    d = F.col("trip_count").cast("double")
    prev = F.lag("trip_count").over(ordered(["zone_id"], "time_bin"))
    df = panel.withColumn("_prev", prev)
    fare, pooled = F.col("avg_fare"), F.col("shared_requested_share")

    def weighted(c: Column) -> Column:
        ok = c.isNotNull() & (d > 0)
        return ratio(F.sum(F.when(ok, c * d)), F.sum(F.when(ok, d)))

    exprs = [
        F.count(F.lit(1)).alias("panel_rows"),
        F.count_distinct("zone_id").alias("zones"),
        F.count_distinct("time_bin").alias("periods"),
        F.sum(d).alias("total_observed_trips"),
        F.avg(d).alias("mean_trips_per_cell"),
        weighted(fare).alias("mean_observed_fare"),
        F.avg(fare).alias("equal_observed_cell_mean_fare"),
        F.corr(fare, d).alias("fare_demand_correlation"),
        weighted(pooled).alias("mean_pooled_trip_share"),
        F.corr(d, "_prev").alias("previous_cell_correlation"),
    ]
    for kind, name in (flags or {}).items():
        c = F.col(name)
        if kind == "income":
            cut = quantiles(panel, [], name, {"q": 0.5}).scalar()
            high, low = c >= F.col("_cut"), c < F.col("_cut")
            df = df.withColumn("_cut", cut)
        else:
            high, low = c.cast("double") > 0, c.cast("double") <= 0
        exprs.append(
            (F.avg(F.when(high, d)) - F.avg(F.when(low, d))).alias(f"{kind}_mean_contrast")
        )
        exprs.append(F.count(c).alias(f"{kind}_known_rows"))
    lagged = exact_lag(
        panel.select("zone_id", "time_bin", d.alias("y")),
        ["zone_id"],
        "time_bin",
        f"interval {minutes} minutes",
        {"y": "prev"},
    ).agg(F.corr("y", "prev").alias("r"), F.count(F.lit(1)).alias("n"))
    found = scalars(lagged)
    return df.agg(*exprs).withColumns(
        {
            "p90_trips_per_cell": quantiles(panel, [], d, {"q": 0.9}).scalar(),
            "exact_lag_correlation": found["r"],
            "exact_lag_support_pairs": found["n"],
        }
    )


def neighbor_exposure(
    assign: DataFrame, edges: DataFrame, history_lags: int = 0, treatment: str = "treatment"
) -> DataFrame:
    """Weight-normalised neighbour treatment per zone and period, and exact own history.

    A zone with a neighbour missing in a period gets a missing exposure, not a partial sum.
    """
    sums = edges.groupBy("focal_zone_id").agg(
        F.sum("weight").alias("_w"), F.count_distinct("neighbor_zone_id").alias("_expected")
    )
    mapping = edges.join(sums, "focal_zone_id").withColumn(
        "_norm", ratio(F.col("weight"), F.col("_w"))
    )
    values = assign.select(
        F.col("zone_id").alias("neighbor_zone_id"), "period_id", F.col(treatment).alias("_t")
    )
    exposure = (
        mapping.join(values, "neighbor_zone_id")
        .groupBy(F.col("focal_zone_id").alias("zone_id"), "period_id")
        .agg(
            F.sum(F.col("_norm") * F.col("_t")).alias("neighbor_exposure"),
            F.count("_t").alias("mapped_neighbor_count"),
            F.max("_expected").alias("expected_neighbor_count"),
        )
    )
    complete = F.col("mapped_neighbor_count") == F.col("expected_neighbor_count")
    out = assign.join(
        exposure.withColumn("neighbor_exposure", F.when(complete, F.col("neighbor_exposure"))),
        ["zone_id", "period_id"],
        "left",
    )
    lags = []
    for k in range(1, history_lags + 1):
        name = f"own_history_lag_{k}"
        prior = assign.select(
            "zone_id", (F.col("period_id") + k).alias("period_id"), F.col(treatment).alias(name)
        )
        out = out.join(prior, ["zone_id", "period_id"], "left")
        lags.append(F.col(name))
    if not lags:
        return out
    known = sum((c.isNotNull().cast("int") for c in lags), F.lit(0))
    mean = sum(lags, F.lit(0.0)) / len(lags)
    return out.withColumns({"history_support": known, "history_exposure": mean})


