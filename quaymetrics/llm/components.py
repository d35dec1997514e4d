"""Connected components of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymetrics.session import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b); component is the least reachable id.

    Each round takes the least label among the neighbours and then the label's own label, so the
    number of rounds grows with the logarithm of a path's length for paths in order. A label only
    falls, and the rounds end when none does. Every round is a table in the shared folder.
    """
    edges = links.select("a", "b").where("a != b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id").select(
            "id", "component", F.least("component", "near").alias("next")
        )
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = stored(
            step.join(jump, "next", "left").select(
                "id", F.least("next", "far").alias("component"), F.col("component").alias("before")
            ),
            "labels",
        )
        changed = moved.where("component < before").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
