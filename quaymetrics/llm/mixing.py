"""Mixing of sources to target weights in blocks of fixed length.

The words of each source, in a hashed order of its documents, are packed into blocks of `block`
words. A source's target is its share by weight, at most `limit` times its size, with the excess
shared again by weight. Its quota of output slots is the target in whole blocks. All quotas are
laid end to end and sent through a pseudorandom permutation onto the output slots, so the source
counts of an output shard are a multinomial draw on the condition that the quotas are met: a free
draw would leave small sources off their targets by its own deviation, and documents above the
limit. The slots of a source run through one pseudorandom permutation of its block indexes per
epoch, and blocks join slots by index.

Null texts have no words, a null source is a source of its own, after all others. Documents without
words are in no block. Repeated rows are mixed as separate documents. The mix depends only on rows
and `seed`. An empty table gives an empty mix; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymetrics.core import running_total
from quaymetrics.llm import text as tx
from quaymetrics.llm.repeats import join_rows, packed, unpacked
from quaymetrics.session import stored

WEIGHTS = (5, 2, 1)
BLOCK = 128
LIMIT = 3
SHARD_SLOTS = 1024
#: Slots that one row of work expands to.
RUN = 1 << 16
#: Documents of one source in one ordered bucket, about.
BUCKET = 4096
WORD = r"[^\x20\x09-\x0D]+"


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) per key: a Feistel network walked until inside."""
    size = size.astype(np.uint64)
    half = np.zeros(len(size), np.uint64)
    while True:
        small = (np.uint64(1) << (half * np.uint64(2))) < size
        if not small.any():
            break
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for step in range(4):
            mixed = tx.mix64(right + k + np.uint64(step * 0x632BE59BD9B4E019 % (1 << 64)))
            left, right = right, left ^ (mixed & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def source_targets(sizes: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """(source, rank, source_size, target): shares by weight, none above `limit` times its size.

    The level is raised until the capped sources' excess is shared: one small sum for each round.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(
        ranked.withColumn(
            "weight", F.element_at(choice, (F.col("rank") % len(weights) + 1).cast("int"))
        ),
        "sources",
    )
    level = 0.0
    while True:
        capped = F.col("weight") * level > limit * F.col("source_size")
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, limit * F.col("source_size"))).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        raised = ((row["all"] or 0) - (row["full"] or 0)) / row["open"]
        if raised <= level:
            break
        level = raised
    return ranked.select(
        "source",
        "rank",
        "source_size",
        F.least(
            F.col("weight") * level, (limit * F.col("source_size")).cast("double")
        ).alias("target"),
    )


def place_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark, start): where each document starts among its source's words."""
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
        ),
        "sizes",
    )
    n = sized.count()
    bucketed = sized.withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(max(1, n // BUCKET)))
    )
    return running_total(
        bucketed, ["source"], "_bucket", ["doc_id", "mark"], F.col("size"), "_end"
    ).select("doc_id", "source", "size", "mark", (F.col("_end") - F.col("size")).alias("start"))


def expand_runs(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Slots and blocks of runs of consecutive picks of one source."""
    for batch in batches:
        for row in batch.to_pylist():
            pick = np.arange(row["first"], min(row["first"] + RUN, row["quota"]))
            n = len(pick)
            whole = np.full(n, row["slots"])
            slot = permute(pick + row["before"], whole, np.full(n, seed, np.uint64))
            epoch = pick // row["blocks"]
            key = tx.mix64(epoch.astype(np.uint64) + tx.mix64(np.array([row["rank"]]))[0])
            block = permute(
                pick % row["blocks"], np.full(n, row["blocks"]), key + np.uint64(seed)
            )
            yield pa.record_batch(
                [
                    pa.array(slot // SHARD_SLOTS),
                    pa.array(slot),
                    pa.array(np.full(n, row["rank"])),
                    pa.array(epoch),
                    pa.array(block),
                ],
                names=["shard", "slot", "rank", "epoch", "block"],
            )


def draw_slots(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """(shard, slot, rank, epoch, block): which block of which source stands in each slot."""
    size, blocks = F.col("source_size"), F.ceil(F.col("source_size") / block)
    rounds = F.floor(F.col("target") / size)
    rest = F.least(F.round((F.col("target") - rounds * size) / block), blocks)
    quotas = targets.where("source_size > 0").select(
        "rank", blocks.alias("blocks"), (rounds * blocks + rest).cast("long").alias("quota")
    )
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(
        quotas.withColumn("before", F.coalesce(F.sum("quota").over(order), F.lit(0).cast("long"))),
        "quotas",
    )
    slots = placed.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("slots")).first()[0]
    runs = placed.where("quota > 0").select(
        "rank",
        "blocks",
        "quota",
        "before",
        F.lit(slots).cast("long").alias("slots"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(RUN).cast("long"))).alias(
            "first"
        ),
    )
    spread = runs.repartition(max(1, min(10_000, slots // RUN + 1)), "rank", "first")
    return spread.mapInArrow(
        lambda b: expand_runs(b, seed), "shard long, slot long, rank long, epoch long, block long"
    )


def cut_blocks(placed: DataFrame, block: int) -> DataFrame:
    """Each document's pieces: (rank, block, doc_id, mark, start, first_word, n_words)."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    begin = F.greatest("start", F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .select(
            "rank",
            "block",
            "doc_id",
            "mark",
            "start",
            (begin - F.col("start")).alias("first_word"),
            (end - begin).alias("n_words"),
        )
    )


class Mix:
    """A mix of documents: `documents` with sizes and targets, `slots`, and the blocks' `pieces`."""

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[int] = WEIGHTS,
        block: int = BLOCK,
        limit: int = LIMIT,
        seed: int = 7,
    ):
        tx.require_columns(docs, "doc_id", "text", "source")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
        placed = place_documents(self.docs)
        targets = source_targets(placed, weights, limit)
        other = targets.withColumnRenamed("source", "_source")
        self.documents = stored(
            placed.join(other, placed["source"].eqNullSafe(other["_source"])).drop("_source"),
            "placed",
        )
        self.slots = stored(draw_slots(targets, block, seed), "slots")
        self.pieces = cut_blocks(self.documents, block)

    def manifest(self) -> DataFrame:
        """One row for each piece of a document in each output slot."""
        return self.slots.join(self.pieces, ["rank", "block"])

    def shard_counts(self) -> DataFrame:
        """How many blocks of each source every output shard has."""
        return self.slots.groupBy("shard", "rank").agg(F.count("*").alias("n_blocks"))

    def taken(self) -> DataFrame:
        """Per document the words that the mix takes, repeats counted."""
        took = self.manifest().groupBy("rank", "start").agg(F.sum("n_words").alias("_taken"))
        own = self.documents.withColumn("_key", F.when(F.col("size") > 0, F.col("start")))
        took = took.withColumnsRenamed({"rank": "_rank", "start": "_start"})
        return own.join(
            took, (own["rank"] == took["_rank"]) & (own["_key"] == took["_start"]), "left"
        ).select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
        )

    def texts(self) -> DataFrame:
        """The mixed blocks: (shard, slot, source, epoch, block, doc_ids, text)."""
        per_doc = self.pieces.groupBy("doc_id", "mark").agg(
            F.collect_list(F.struct("rank", "block", "start", "first_word", "n_words")).alias("cuts")
        )
        texts = packed(self.docs).dropDuplicates(["doc_id", "crc"])
        parts = (
            join_rows(texts, per_doc.withColumnRenamed("mark", "crc"), "inner")
            .select("doc_id", "packed", "cuts")
            .mapInArrow(cut_pieces, "rank long, block long, start long, doc_id long, part string")
        )
        blocks = (
            parts.groupBy("rank", "block")
            .agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "part"))).alias("parts"))
            .select(
                "rank",
                "block",
                F.col("parts.doc_id").alias("doc_ids"),
                F.array_join("parts.part", " ").alias("text"),
            )
        )
        names = self.documents.select("rank", "source").distinct()
        return (
            self.slots.join(blocks, ["rank", "block"])
            .join(names, "rank")
            .select("shard", "slot", "source", "epoch", "block", "doc_ids", "text")
        )


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            words = tx.Words(unpacked(row.column("packed")))
            cuts = row.column("cuts").flatten()
            parts = []
            for first, n in zip(
                cuts.field("first_word").to_pylist(), cuts.field("n_words").to_pylist(), strict=True
            ):
                own = slice(first, first + n)
                parts.append(
                    b" ".join(
                        words.raw[a:e].tobytes()
                        for a, e in zip(words.starts[own], words.ends[own], strict=True)
                    )
                )
            yield pa.record_batch(
                [
                    cuts.field("rank"),
                    cuts.field("block"),
                    cuts.field("start"),
                    row.column("doc_id").take(pa.array(np.zeros(len(parts), np.int64))),
                    pa.array(parts, pa.binary()).cast(pa.string()),
                ],
                names=["rank", "block", "start", "doc_id", "part"],
            )
