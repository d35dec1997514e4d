"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of documents of one task. Its words are mapped to the alphabet of the test
phrases; every other word parts the text, and stretches too short for a phrase hold none and are
left out. The phrases are searched backwards through wavelet ranks, their occurrences located by
sampled suffix positions, and the spans they cover merged. Phrases of one block do not shuffle the
documents. With several blocks the documents are written once with a key of each row, and the driver
holds one block at a time.

Null and empty texts have no words and no hits. Repeated rows are treated one by one. Items with
a null id count for spans but are not listed; items without words are ignored. No documents or no
items give no hits. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm import text as tx
from quaymetrics.llm.fm_index import FmIndex
from quaymetrics.session import forget, stored

WINDOW = 10
#: Test phrases go to the tasks in blocks of items of at most about this many characters.
BLOCK_CHARS = 4 << 20
RESULT = (
    "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
)


class Phrases:
    """The distinct windows of a block of items over an alphabet of their own words."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        words = tx.Words(pa.array(texts, pa.string()), tx.NOT_WORD, lower=True)
        self.window = window
        self.alphabet, symbols = np.unique(words.hashes(), return_inverse=True)
        symbols = symbols + 1
        rows: dict[bytes, set[str]] = {}
        for i, name in enumerate(ids):
            own = symbols[words.bounds[i] : words.bounds[i + 1]].astype(np.int32)
            width = min(window, len(own))
            for at in range(len(own) - width + 1) if width else ():
                names = rows.setdefault(own[at : at + width].tobytes(), set())
                if name is not None:
                    names.add(name)
        keys = [np.frombuffer(k, np.int32) for k in rows]
        self.names = [sorted(v) for v in rows.values()]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.patterns = np.zeros((len(keys), window), np.int64)
        for row, key in enumerate(keys):
            self.patterns[row, window - len(key) :] = key
        self.shortest = int(self.lengths.min()) if len(keys) else window

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words by hash, 0 for words of no phrase."""
        if not len(self.alphabet):
            return np.zeros(len(hashes), np.int64)
        seen = np.zeros(1 << 16, bool)
        seen[self.alphabet & np.uint64(0xFFFF)] = True
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(seen[hashes & np.uint64(0xFFFF)])
        place = np.searchsorted(self.alphabet, hashes[maybe])
        place = np.minimum(place, len(self.alphabet) - 1)
        hit = self.alphabet[place] == hashes[maybe]
        out[maybe[hit]] = place[hit] + 1
        return out


def stretches(
    symbols: np.ndarray, bounds: np.ndarray, shortest: int
) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least `shortest` known words within a text, each followed by a 0; and the place
    of every symbol among the words."""
    known = symbols > 0
    first = known.copy()
    first[1:] &= ~known[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(symbols)]
    first[cuts] = known[cuts]
    starts = np.flatnonzero(first)
    stop = np.flatnonzero(~known)
    ends = np.append(stop, len(symbols))[np.searchsorted(stop, starts)]
    ends = np.minimum(ends, bounds[np.searchsorted(bounds, starts, side="right")])
    long = ends - starts >= shortest
    starts, lengths = starts[long], (ends - starts)[long]
    place = tx.ranges(starts, lengths + 1)
    out = symbols[np.minimum(place, max(len(symbols) - 1, 0))]
    out[np.cumsum(lengths + 1) - 1] = 0
    return out, place


def shard_hits(words: tx.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and phrase of every occurrence in a shard."""
    symbols = phrases.symbols(words.hashes())
    text, place = stretches(symbols, words.bounds, phrases.shortest)
    none = np.zeros(0, np.int64)
    if not len(text) or not len(phrases.lengths):
        return none, none, none
    index = FmIndex(text, len(phrases.alphabet) + 1)
    low, high = index.search(phrases.patterns, phrases.lengths)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    at = place[index.locate(tx.ranges(low, count))]
    return at, phrases.lengths[phrase], phrase


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Spans that touch or overlap as one; `starts` in order."""
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1])) if len(starts) else []
    last = np.append(first[1:], len(starts)) - 1 if len(starts) else []
    return [{"start": int(starts[a]), "end": int(reach[b])} for a, b in zip(first, last)]


def search_shards(
    batches: Iterator[pa.RecordBatch], phrases: Phrases
) -> Iterator[pa.RecordBatch]:
    """The columns besides the text, and what was found in it."""
    for shard in tx.merged(batches):
        words = tx.Words(shard.column("text"), tx.NOT_WORD, lower=True)
        at, length, phrase = shard_hits(words, phrases)
        sort = np.lexsort((length, at))
        at, length, phrase = at[sort], length[sort], phrase[sort]
        rows = np.searchsorted(at, words.bounds)
        spans, items = [], []
        for i in range(shard.num_rows):
            a, b, base = rows[i], rows[i + 1], words.bounds[i]
            if a == b:
                spans.append([])
                items.append([])
                continue
            spans.append(merge_spans(at[a:b] - base, at[a:b] + length[a:b] - base))
            names = {n for p in np.unique(phrase[a:b]) for n in phrases.names[p]}
            items.append(sorted(names))
        own = [n for n in shard.schema.names if n != "text"]
        yield pa.record_batch(
            [
                *[shard.column(n) for n in own],
                pa.array(np.diff(words.bounds), pa.int64()),
                pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=[*own, "n_words", "spans", "items"],
        )


class Blocks:
    """The items in blocks whose size is measured first; the phrases of one are made at a time."""

    def __init__(self, items: DataFrame, window: int, block_chars: int):
        tx.require_columns(items, "item_id", "text")
        self.window = window
        self.items = (
            items.select(F.col("item_id").cast("string").alias("item_id"), "text")
            .where(F.col("text").isNotNull())
            .distinct()  # copies of an item would all be in one block
        )
        size = self.items.agg(F.sum(F.length("text"))).first()[0] or 0
        self.n = max(1, -(-size // block_chars))

    def phrases(self, k: int) -> Phrases:
        block = self.items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == k)
        rows = block.collect()
        return Phrases([r.item_id for r in rows], [r.text for r in rows], self.window)


def search(docs: DataFrame, phrases: Phrases, schema: str = RESULT) -> DataFrame:
    return docs.mapInArrow(lambda b: search_shards(b, phrases), schema)


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Per row of documents: its words, the merged word spans that phrases cover, and the items found.

    `docs` has doc_id and text, `items` item_id and text. The items reach the tasks in blocks of
    bounded size; with several blocks the documents are read once for each.
    """
    tx.require_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = Blocks(items, window, block_chars)
    if blocks.n == 1:
        return search(docs, blocks.phrases(0))
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "leak_rows")
    rows = rows.select("row", "doc_id", "text")
    found = []
    for k in range(blocks.n):
        part = search(rows, blocks.phrases(k), "row long, " + RESULT)
        # the first block gives every row, the others those with hits
        found.append(stored(part if k == 0 else part.where(F.size("spans") > 0), "leak_block"))
    return merge_blocks(found)


def merge_blocks(found: list[DataFrame]) -> DataFrame:
    """Results of several blocks of items over the same documents, by `row`, as one per row."""
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    spans = F.sort_array(F.flatten(F.collect_list("spans")))
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        spans,
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= last(acc)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        last(acc)["start"].alias("start"),
                        F.greatest(last(acc)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return (
        whole.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            joined.alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .drop("row")
    )


def n_hit() -> Column:
    return F.aggregate(
        "spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]
    )


def leak_report(leaks: DataFrame) -> DataFrame:
    """One digest row per document of find_leaks()."""
    return leaks.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        "items",
    )


def clean_rows(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for shard in tx.merged(batches):
        words = tx.Words(shard.column("text"), tx.NOT_WORD, lower=True)
        at, _, _ = shard_hits(words, phrases)
        dirty = np.zeros(shard.num_rows, bool)
        dirty[np.searchsorted(words.bounds, at, side="right") - 1] = True
        yield shard.filter(pa.array(~dirty))


def drop_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The rows in whose text no phrase occurs, with all columns as they were."""
    tx.require_columns(docs, "text")
    blocks = Blocks(items, window, block_chars)
    for k in range(blocks.n):
        clean = docs.mapInArrow(lambda b, p=blocks.phrases(k): clean_rows(b, p), docs.schema)
        if blocks.n == 1:
            return clean
        before, docs = docs, stored(clean, "clean_rows")
        if k:  # the first is the caller's
            forget(before)
    return docs
