"""Removal of repeated byte strings by suffix arrays.

In each shard of candidate stretches (see repeats.py), the text covered by windows whose fingerprint
occurs twice has a whole suffix array made by Larsson-Sadakane refinement and Kasai's common prefixes; neighbours that share `length` bytes start a string that
occurs again. Anchors that need several shards are merged by binary search in their sorted runs.

Null texts are empty. A text shorter than `length` loses nothing. Equal rows, the same doc_id or
not, repeat each other, so all their strings go. Matches never cross texts. Null ids are kept as a
document of their own text. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm import repeats
from quaymetrics.llm import text as tx
from quaymetrics.llm.suffixes import common_prefixes, refine

LENGTH = 400
GRAM = 32
#: Bytes that one symbol of the first sort holds.
PACKED = 7
RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>"


def packed_symbols(raw: np.ndarray) -> np.ndarray:
    """Each byte and the next six as one number that sorts like them, the end before all bytes."""
    padded = np.concatenate([raw.astype(np.int64) + 1, np.zeros(PACKED, np.int64)])
    out = np.zeros(len(raw), np.int64)
    for k in range(PACKED):
        out = out * 257 + padded[k : k + len(raw)]
    return out


def likely_windows(shard: repeats.Shard, length: int) -> np.ndarray:
    """Places among the shard's windows of those whose fingerprint occurs twice; all repeated
    windows are among them, as equal windows have equal fingerprints."""
    start, _ = shard.window_starts(length)
    prints = repeats.rolling(shard.units.hash, length)[start]
    order = np.argsort(prints)
    same = prints[order[1:]] == prints[order[:-1]]
    again = np.zeros(len(start), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def repeated_windows(shard: repeats.Shard, rule: repeats.Rule) -> np.ndarray:
    """Which windows of the shard occur at least twice in it.

    Only the text that likely windows cover is sorted. The suffix order then tells which of them
    are equal byte by byte.
    """
    start, owner = shard.window_starts(rule.length)
    hit = np.zeros(len(start), bool)
    picked = likely_windows(shard, rule.length)
    if not len(picked):
        return hit
    at, of = start[picked], owner[picked]
    head = np.ones(len(at), bool)
    head[1:] = (of[1:] != of[:-1]) | (at[1:] > at[:-1] + rule.length)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(at)) - 1
    sizes = at[last] + rule.length - at[first]
    raw = shard.units.raw[tx.ranges(at[first], sizes)]
    moved = at - np.repeat(at[first] - (np.cumsum(sizes) - sizes), np.diff(np.append(first, len(at))))
    # Kasai's floors hold for a whole order only
    order, _ = refine(packed_symbols(raw), len(raw), step=PACKED)
    prefix = common_prefixes(raw, order, rule.length)
    group = np.cumsum(prefix < rule.length) - 1
    valid = np.zeros(len(raw), bool)
    valid[moved] = True
    members = np.bincount(group, valid[order], len(order) + 1)
    often = np.zeros(len(raw), bool)
    often[order] = members[group] > 1
    hit[picked] = often[moved]
    return hit


def cut_spans(
    batches: Iterator[pa.RecordBatch], words: bool
) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and the merged spans that went."""
    for batch in batches:
        kept, merged, sizes = [], [], []
        spans = batch.column("spans")
        for i in range(batch.num_rows):
            units = repeats.Units(repeats.unpacked(batch.column("packed").slice(i, 1)), words)
            n = int(units.bounds[-1])
            own = spans.slice(i, 1).flatten()
            gone = tx.covered(
                own.field("start").to_numpy(zero_copy_only=False).astype(np.int64),
                own.field("end").to_numpy(zero_copy_only=False).astype(np.int64),
                n,
            )
            if words:
                kept.append(units.words.take(~gone)[0].as_py())
            else:
                kept.append(units.raw[~gone].tobytes())
            edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            merged.append(
                [
                    {"start": a, "end": b}
                    for a, b in zip(
                        np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                    )
                ]
            )
            sizes.append(n)
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(kept, pa.binary()),
                pa.array(merged, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
            ],
            names=["doc_id", "n_bytes" if not words else "n_words", "kept", "spans"],
        )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, shard_bytes: int = repeats.SHARD_BYTES
) -> DataFrame:
    """Per document: its bytes, what is left of them, and the removed spans in bytes.

    Removed is each byte covered by a string of `length` bytes that also starts anywhere else.
    """
    tx.require_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rule = repeats.Rule(
        length, min(GRAM, length), words=False, earlier=False, shard_bytes=shard_bytes
    )
    spans = repeats.repeated_spans(docs, rule, repeated_windows)
    return repeats.with_spans(docs, spans).mapInArrow(lambda b: cut_spans(b, False), RESULT)


def removed(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def repeat_report(cut: DataFrame) -> DataFrame:
    """One digest row per document of remove_repeats()."""
    return cut.select(
        "doc_id",
        "n_bytes",
        removed().alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
