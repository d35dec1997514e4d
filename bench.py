"""Time the headline queries: BENCH_SF_DIR and BENCH_CPUS choose data and cores.

Each runs twice: `cold` counts the first run, staging of shared layers included, `queries` the second.
`heavy` are further queries, run once and not part of `value`.
`calibration` is a fixed aggregation, to compare machines by.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from quaymetrics.session import local_session

HEADLINE = (
    "A01_zone_time_panel",
    "A02_od_flow",
    "A03_trip_moments",
    "A06_node_table",
    "J08_complete_grid",
    "A12_entity_events",
    "L01_episodes",
    "A14_active_stock",
    "L04_kaplan_meier",
    "Q04_panel_checks",
    "T03_monthly_rate",
    "T05_trade_panel",
    "A26_decompose",
    "V01_as_of",
    "J06_snapshots",
    "V06_features_as_of",
    "B02_baseline_forecasts",
    "E08_ols_two_way",
    "W11_ranked_plan",
    "P25_amortization_schedule",
)

HEAVY = (
    "A09_cross_zone_correlation",
    "E16_wild_bootstrap",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")

    import quaymetrics.plans  # noqa: F401
    from quaymetrics.registry import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    def calibrate() -> float:
        start = time.perf_counter()
        spark.range(100_000_000).selectExpr("sum(id * 7 % 1000)").collect()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in HEADLINE}
    # layers that several queries share are staged by now; the JVM has compiled
    times = {name: run(name) for name in HEADLINE}
    heavy = {name: run(name) for name in HEAVY}
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold_total": round(sum(cold.values()), 3),
                "cold": cold,
                "heavy": heavy,
                "calibration": median(calibrate() for _ in range(3)),
                "lineitem_rows": lines,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
