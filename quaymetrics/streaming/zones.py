"""Incremental ingest of a growing trip log and running zone counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymetrics.core import time_bin
from quaymetrics.sources.io import scratch


def read_log(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str, max_files: int = 64
) -> DataFrame:
    """Files of a folder as a stream; new files are picked up by later runs."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def ingest_stream(
    source: DataFrame,
    normalize: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> DataFrame:
    """Normalise what is new and append it; a replayed batch replaces its own folder.

    Returns the ingested table. Each run takes what is available and stops.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        normalize(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return source.sparkSession.read.parquet(path)


def reconcile_rows(ingested: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows ingested against rows in the source."""
    n = batch.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ingested.agg(
        F.count(F.lit(1)).alias("ingested_rows"),
        F.count_distinct("batch_id").alias("batches"),
    ).select(
        "ingested_rows",
        n.alias("source_rows"),
        (F.col("ingested_rows") == n).alias("reconciled"),
    )


CELL = ["source", "zone_type", "zone_id", "time_bin"]
COUNTS = ["trip_count", "total_fare", "od_pair_observed_count"]


def zone_sums(trips: DataFrame, minutes: int = 15) -> DataFrame:
    """Additive sums of trips per zone and tumbling window."""
    return trips.groupBy(
        "source",
        "zone_type",
        F.col("pickup_zone_id").alias("zone_id"),
        time_bin("pickup_datetime", minutes).alias("time_bin"),
    ).agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.sum("fare").alias("total_fare"),
        F.count("dropoff_zone_id").alias("od_pair_observed_count"),
    )


def zone_time_stream(trips: DataFrame, path: str, checkpoint: str, minutes: int = 15) -> DataFrame:
    """Running counts per zone and tumbling window, however late a row comes.

    Counts and sums are additive, so each batch leaves its own sums and the table is their total:
    no state to expire and no watermark that would drop late rows. A replayed batch replaces its
    folder. Sums of all batches up to a run's end are folded into one table, which a later run
    reads instead of them. A source without rows gives an empty table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = zone_sums(batch, minutes)
        sums.write.mode("overwrite").parquet(f"{path}/deltas/batch_id={batch_id}")

    query = (
        trips.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = trips.sparkSession
    empty = zone_sums(spark.createDataFrame([], trips.schema), minutes)
    return Totals(spark, path).fold(empty)


class Totals:
    """Folded totals under `path`, in versions.

    totals/<name> holds the sums of all batches up to one, and manifest/<last batch> the name of the
    table that counts. A manifest is renamed into place only when its table is finished, so a crash
    before that leaves the version before it and the batches' own sums as they were; what it left
    behind, folded batches and older versions go when a later version is in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.files = self.Path(path).getFileSystem(conf)

    def names(self, folder: str) -> list[str]:
        where = self.Path(f"{self.path}/{folder}")
        if not self.files.exists(where):
            return []
        return [x.getPath().getName() for x in self.files.listStatus(where)]

    def version(self) -> tuple[int, str | None]:
        """The last batch that is folded, and its table."""
        done = [n for n in self.names("manifest") if not n.startswith((".", "_"))]
        if not done:
            return -1, None
        last = max(done, key=int)
        text = self.spark.read.text(f"{self.path}/manifest/{last}").first()["value"]
        return int(last), text

    def publish(self, last: int, name: str) -> None:
        new = self.Path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = self.files.create(new)
        out.write(bytearray(f"{name}\n".encode()))
        out.close()
        if not self.files.rename(new, self.Path(f"{self.path}/manifest/{last}")):
            raise OSError(f"could not publish the totals up to batch {last}")

    def fold(self, empty: DataFrame) -> DataFrame:
        """Totals of all finished batches; `empty` has their columns and no row."""
        done, name = self.version()
        batches = [
            int(n.partition("=")[2])
            for n in self.names("deltas")
            if n.startswith("batch_id=") and "_SUCCESS" in self.names(f"deltas/{n}")
        ]
        new = sorted(b for b in batches if b > done)
        if new:
            read = self.spark.read.schema(empty.schema)
            rows = read.parquet(*[f"{self.path}/deltas/batch_id={b}" for b in new])
            if name:
                rows = rows.unionByName(read.parquet(f"{self.path}/totals/{name}"))
            done, name = new[-1], f"upto-{new[-1]}-{uuid.uuid4().hex}"
            total = rows.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in COUNTS])
            total.write.parquet(f"{self.path}/totals/{name}")
            self.publish(done, name)
        self.clean(done, name, batches)
        if name is None:
            return empty
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/totals/{name}")

    def clean(self, done: int, name: str | None, batches: list[int]) -> None:
        """Deletes folded batches, and tables and manifests that no longer count."""
        gone = [f"deltas/batch_id={b}" for b in batches if b <= done]
        gone += [f"totals/{n}" for n in self.names("totals") if n != name]
        gone += [f"manifest/{n}" for n in self.names("manifest") if n != str(done)]
        for folder in gone:
            self.files.delete(self.Path(f"{self.path}/{folder}"), True)


def places(spark: SparkSession, name: str) -> tuple[str, str]:
    return scratch(spark, name), scratch(spark, f"{name}-checkpoint")
