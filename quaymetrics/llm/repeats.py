"""Where long passages repeat: routing of candidate stretches to shards, whatever searches them.

A window is `length` consecutive units (words or bytes) of one text. The least hash among the
grams of a window is its anchor; neighbouring windows with one anchor form a stretch. Equal windows
have equal anchors, so windows are compared within the stretches of one anchor only:

1. an anchor with one stretch repeats nothing; equal stretches are settled by a hash of their
   units, without moving their text;
2. anchors with several different stretches send these to shards of bounded size, where a
   searcher (suffix array or FM-index) finds the equal windows exactly;
3. an anchor too large for a shard is split over several, and the shards' window fingerprints are
   merged by binary search in sorted runs, dealt by fingerprint.

Every step pre-aggregates or deals by more than the anchor, so one passage that a third of all
documents share does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm import text as tx
from quaymetrics.session import stored

#: Windows of a stretch at most, so that its place and length share one number.
LONGEST_RUN = 1 << 20
SHARD_BYTES = 1 << 20
STRETCH = "anchor long, same long, doc_id long, crc long, at long"
PAYLOAD = "anchor long, shard long, split boolean, doc_id long, crc long, at long, part binary"
SPAN = "doc_id long, crc long, start long, end long"


@dataclass(frozen=True)
class Rule:
    """What repeats and what is removed."""

    length: int
    gram: int
    words: bool
    #: a window goes only if a smaller doc_id has it; otherwise if it starts anywhere else
    earlier: bool
    shard_bytes: int


class Units:
    """Hashes of the words or bytes of texts, and where each text's units start."""

    def __init__(self, column: pa.Array, words: bool):
        if words:
            self.words = tx.Words(column)
            self.hash = self.words.hashes()
            self.bounds = self.words.bounds
            self.raw = self.words.raw
        else:
            self.words = None
            self.raw, self.bounds = tx.raw_bytes(column)
            self.hash = tx.mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))[self.raw]

    def same(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the units of each stretch."""
        if self.words is None:
            return tx.hash_spans(self.raw, starts, ends)
        return tx.hash_spans(self.hash.view(np.uint8), starts * 8, ends * 8)

    def cut(self, start: int, end: int) -> bytes:
        if self.words is None:
            return self.raw[start:end].tobytes()
        return self.raw[self.words.starts[start] : self.words.ends[end - 1]].tobytes()


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive hashes, shorter near the end."""
    base = 0x9E3779B97F4A7C15
    out, done = None, 0
    power, width = hashes, 1
    factor = base
    while True:
        if length & width:
            # units [i, i + done) are in out already; append those of power
            if out is None:
                out = power.copy()
            else:
                ahead = np.zeros_like(power)
                ahead[: len(power) - min(done, len(power))] = power[done:]
                out = out * np.uint64(pow(base, width, 1 << 64)) + ahead
            done += width
        if width * 2 > length:
            return tx.mix64(out)
        ahead = np.zeros_like(power)
        ahead[: len(power) - min(width, len(power))] = power[width:]
        power = power * np.uint64(factor) + ahead
        width *= 2
        factor = factor * factor % (1 << 64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    least, done = values, 1
    while done * 2 <= width:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    rest = width - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def stretches(units: Units, rule: Rule) -> tuple[np.ndarray, ...]:
    """Per stretch: its text, anchor, first unit, end, and whether the anchor stands in it twice."""
    n = len(units.hash)
    none = np.zeros(0, np.int64)
    if n < rule.length:
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    grams = rolling(units.hash, rule.gram)
    least = sliding_least(grams[: n - rule.gram + 1], rule.length - rule.gram + 1)
    sizes = np.diff(units.bounds)
    windows = np.maximum(sizes - rule.length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    start = tx.ranges(units.bounds[:-1], windows)
    anchor = least[start]
    head = np.ones(len(start), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(start))
    head |= (place - np.maximum.accumulate(np.where(head, place, 0))) % LONGEST_RUN == 0
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1
    a, e = start[first], start[last] + rule.length
    keys = anchor[first]
    width = rule.length - rule.gram + 1
    # occurrences of the anchor in [a, e - gram]: all lie in the first or the last window
    inner = np.zeros(len(first), bool)
    for from_, to in ((a, a + width), (np.maximum(e - rule.length, a + width), e - rule.gram + 1)):
        size = np.maximum(to - from_, 0)
        hit = grams[tx.ranges(from_, size)] == np.repeat(keys, size)
        counts = np.concatenate([[0], np.cumsum(hit)])
        stop = np.cumsum(size)
        inner |= counts[stop] - counts[stop - size] > (1 if from_ is a else 0)
    long = e - a > 2 * rule.length
    return owner[first], keys, a, e, (inner | long) & (not rule.earlier)


def checksum(column: pa.Array) -> pa.Array:
    """Tells apart rows that share a doc_id; the same 64 bits as SQL's xxhash64 of the text."""
    texts = tx.as_strings(column).cast(pa.binary()).to_pylist()
    prints = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64)
    return pa.array(prints.view(np.int64), pa.int64())


def find_stretches(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for chunk in tx.merged(batches):
        units = Units(chunk.column("text"), rule.words)
        owner, anchor, a, e, twice = stretches(units, rule)
        same = units.same(a, e)
        base = units.bounds[owner]
        at = (twice.astype(np.int64) << 62) | ((a - base) << 24) | (e - a)
        rows = pa.array(owner)
        yield pa.record_batch(
            [
                pa.array(anchor.view(np.int64)),
                pa.array(same.view(np.int64)),
                chunk.column("doc_id").take(rows),
                checksum(chunk.column("text")).take(rows),
                pa.array(at),
            ],
            names=["anchor", "same", "doc_id", "crc", "at"],
        )


def start_of() -> Column:
    return F.shiftright(F.col("at").bitwiseAND((1 << 62) - 1), 24)


def size_of() -> Column:
    return F.col("at").bitwiseAND((1 << 24) - 1)


def twice_in() -> Column:
    return F.col("at") >= (1 << 62)


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way through a shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for chunk in tx.merged(batches):
        raw = tx.as_strings(chunk.column("text")).cast(pa.binary()).to_pylist()
        yield pa.record_batch(
            [
                chunk.column("doc_id"),
                checksum(chunk.column("text")),
                pa.array([press.compress(t) for t in raw], pa.binary()),
            ],
            names=["doc_id", "crc", "packed"],
        )


def packed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(
        pack_texts, "doc_id long, crc long, packed binary"
    )


def unpacked(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(t) for t in column.to_pylist()], pa.binary()).cast(pa.string())


def cut_parts(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """The text of each wanted stretch of each document."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            units = Units(unpacked(row.column("packed")), rule.words)
            wanted = row.column("wanted").flatten()
            start = wanted.field("start").to_numpy(zero_copy_only=False)
            size = wanted.field("size").to_numpy(zero_copy_only=False)
            n = len(start)
            ids = pa.array(np.zeros(n, np.int64))
            yield pa.record_batch(
                [
                    wanted.field("anchor"),
                    wanted.field("shard"),
                    wanted.field("split"),
                    row.column("doc_id").take(ids),
                    row.column("crc").take(ids),
                    wanted.field("at"),
                    pa.array([units.cut(a, a + s) for a, s in zip(start, size)], pa.binary()),
                ],
                names=["anchor", "shard", "split", "doc_id", "crc", "at", "part"],
            )


def spans_of(hit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of what windows at the sorted places `hit` cover, touching ones as one."""
    if not len(hit):
        return hit, hit
    head = np.append(True, hit[1:] > hit[:-1] + length)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(hit)) - 1
    return hit[first], hit[last] + length


@dataclass
class Shard:
    """The stretches of one shard, one after the other."""

    units: Units
    #: rank of each stretch's doc_id, null last
    doc_rank: np.ndarray

    def window_starts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and stretch of every window."""
        sizes = np.maximum(np.diff(self.units.bounds) - length + 1, 0)
        return tx.ranges(self.units.bounds[:-1], sizes), np.repeat(np.arange(len(sizes)), sizes)


#: Finds the windows of a shard that repeat by the rule: True for each window of window_starts().
Search = Callable[[Shard, Rule], np.ndarray]

FOUND = (
    "anchor long, lane long, prints binary, docs binary, crcs binary, places binary, "
    "doc_id long, crc long, start long, end long"
)


def search_shard(table: pa.Table, rule: Rule, search: Search, lanes: int) -> pa.Table:
    """Spans of repeated windows; and of split anchors, window fingerprints for the merge."""
    table = table.combine_chunks()
    # an order of its own, as rows come in any; ids decide, then place
    table = table.take(
        pc.sort_indices(
            table, [(n, "ascending") for n in ("anchor", "doc_id", "crc", "at")]
        )
    )
    parts = table.column("part").combine_chunks().cast(pa.string(), safe=False)
    units = Units(parts, rule.words)
    ids = table.column("doc_id").to_pandas()
    rank = ids.rank(method="dense", na_option="bottom").to_numpy().astype(np.int64)
    shard = Shard(units, rank)
    start, owner = shard.window_starts(rule.length)
    hit = search(shard, rule)
    out = {n: [] for n in ("doc_id", "crc", "start", "end")}
    at = table.column("at").to_numpy()
    base = ((at & ((1 << 62) - 1)) >> 24) - units.bounds[:-1]
    crc = table.column("crc").to_numpy()
    found = np.flatnonzero(hit)
    cuts = np.searchsorted(owner[found], np.arange(len(base) + 1))
    id_list = table.column("doc_id").to_pylist()
    for i in np.unique(owner[found]):
        a, e = spans_of(start[found[cuts[i] : cuts[i + 1]]] + base[i], rule.length)
        out["doc_id"] += [id_list[i]] * len(a)
        out["crc"] += [int(crc[i])] * len(a)
        out["start"] += a.tolist()
        out["end"] += e.tolist()
    spans = pa.table(
        {
            **{n: pa.nulls(len(out["crc"]), t) for n, t in _RUN},
            **{n: pa.array(v, pa.int64()) for n, v in out.items()},
        }
    )
    return pa.concat_tables([spans, split_runs(table, shard, rule, start, owner, hit, base, lanes)])


_RUN = (
    ("anchor", pa.int64()),
    ("lane", pa.int64()),
    ("prints", pa.binary()),
    ("docs", pa.binary()),
    ("crcs", pa.binary()),
    ("places", pa.binary()),
)
_LAST = np.iinfo(np.int64).max


def split_runs(
    table: pa.Table,
    shard: Shard,
    rule: Rule,
    start: np.ndarray,
    owner: np.ndarray,
    hit: np.ndarray,
    base: np.ndarray,
    lanes: int,
) -> pa.Table:
    """Sorted fingerprints of the windows of split anchors, dealt into lanes by fingerprint."""
    rows: dict[str, list] = {n: [] for n, _ in _RUN}
    split = table.column("split").to_numpy(zero_copy_only=False)
    if split.any():
        prints = rolling(shard.units.hash, rule.length)
        anchor = table.column("anchor").to_numpy()
        ids = pc.fill_null(table.column("doc_id"), _LAST).to_numpy()
        crc = table.column("crc").to_numpy()
        for key in np.unique(anchor[split]):
            own = np.flatnonzero(anchor[owner] == key)
            value = prints[start[own]]
            sort = np.argsort(value, kind="stable")
            own, value = own[sort], value[sort]
            lane = (value >> np.uint64(40)) % np.uint64(lanes)
            for k in np.unique(lane):
                pick = lane == k
                who = owner[own[pick]]
                rows["anchor"].append(int(key))
                rows["lane"].append(int(k))
                rows["prints"].append(value[pick].tobytes())
                rows["docs"].append(ids[who].tobytes())
                rows["crcs"].append(crc[who].tobytes())
                rows["places"].append((start[own[pick]] + base[who]).tobytes())
    n = len(rows["lane"])
    return pa.table(
        {
            **{n: pa.array(rows[n], t) for n, t in _RUN},
            **{c: pa.nulls(n, pa.int64()) for c in ("doc_id", "crc", "start", "end")},
        }
    )


def merge_runs(table: pa.Table, rule: Rule) -> pa.Table:
    """Windows of one anchor and lane that stand in several shards' sorted runs."""
    runs = {
        n: [np.frombuffer(x, np.uint64 if n == "prints" else np.int64) for x in table[n].to_pylist()]
        for n in ("prints", "docs", "crcs", "places")
    }
    every = np.sort(np.concatenate(runs["prints"]))
    if rule.earlier:
        kept = np.unique(every)
        least = np.full(len(kept), _LAST)
        for value, doc in zip(runs["prints"], runs["docs"], strict=True):
            np.minimum.at(least, np.searchsorted(kept, value), doc)
    out = []
    for value, doc, crc, place in zip(*runs.values(), strict=True):
        if rule.earlier:
            again = least[np.searchsorted(kept, value)] < doc
        else:
            left = np.searchsorted(every, value, side="left")
            again = np.searchsorted(every, value, side="right") - left > 1
        out.append((doc[again], crc[again], place[again]))
    doc, crc, place = (np.concatenate(x) for x in zip(*out, strict=True))
    sort = np.lexsort((place, crc, doc))
    doc, crc, place = doc[sort], crc[sort], place[sort]
    head = np.ones(len(doc), bool)
    head[1:] = (
        (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (place[1:] > place[:-1] + rule.length)
    )
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(doc)) - 1
    last = last[: len(first)]
    return pa.table(
        {
            "doc_id": pa.array(doc[first], mask=doc[first] == _LAST),
            "crc": crc[first],
            "start": place[first],
            "end": place[last] + rule.length,
        }
    )


def repeated_spans(docs: DataFrame, rule: Rule, search: Search) -> DataFrame:
    """(doc_id, crc, start, end) of all passages to remove, in units, overlaps not merged."""
    found = stored(
        docs.select("doc_id", "text").mapInArrow(lambda b: find_stretches(b, rule), STRETCH),
        "stretches",
    )
    order = F.coalesce("doc_id", F.lit(_LAST))
    anchors = (
        found.groupBy("anchor")
        .agg(
            F.count("*").alias("n"),
            F.min("same").alias("least_same"),
            F.max("same").alias("most_same"),
            F.min(order).alias("first_doc"),
            F.max(twice_in()).alias("twice"),
        )
        .where((F.col("n") > 1) | F.col("twice"))
    )
    known = stored(
        found.join(anchors, "anchor").select(
            *found.columns,
            "n",
            "first_doc",
            ((F.col("least_same") != F.col("most_same")) | F.col("twice")).alias("open"),
        ),
        "anchored",
    )
    settled = known.where(~F.col("open"))
    unsettled = known.where("open")
    groups = unsettled.groupBy("anchor", "same").agg(
        F.count("*").alias("n"), F.min(order).alias("first_doc")
    )
    unsettled = unsettled.drop("n", "first_doc").join(groups, ["anchor", "same"])
    gone = order > F.col("first_doc") if rule.earlier else F.col("n") > 1
    whole = settled.where(gone).select("doc_id", "crc", "at")
    # one of equal stretches stands for all that are not gone already
    unsettled = stored(
        unsettled.withColumn("gone", gone).select(
            "anchor", "same", "doc_id", "crc", "at", "gone", "first_doc", "n"
        ),
        "unsettled",
    )
    whole = whole.unionByName(unsettled.where("gone").select("doc_id", "crc", "at"))
    if rule.earlier:
        parts = unsettled.where(~F.col("gone"))
    else:
        single = unsettled.where("n = 1").select("anchor", "same", "doc_id", "crc", "at")
        many = (
            unsettled.where("n > 1")
            .groupBy("anchor", "same")
            .agg(F.min(F.struct("doc_id", "crc", "at")).alias("one"))
            .select("anchor", "same", "one.*")
        )
        parts = single.unionByName(many)
    searched = search_parts(docs, parts.select("anchor", "same", "doc_id", "crc", "at"), rule, search)
    spans = whole.select(
        "doc_id", "crc", start_of().alias("start"), (start_of() + size_of()).alias("end")
    )
    return spans.unionByName(searched)


def search_parts(docs: DataFrame, parts: DataFrame, rule: Rule, search: Search) -> DataFrame:
    """Spans of windows that repeat among stretches of one anchor."""
    parts = stored(parts.withColumn("size", size_of()), "parts")
    unit_bytes = 7 if rule.words else 1
    limit = max(1, rule.shard_bytes // unit_bytes)
    total = parts.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // limit))
    loads = parts.groupBy("anchor").agg(F.sum("size").alias("load"))
    hot = loads.where(F.col("load") > limit).select(
        "anchor", F.ceil(F.col("load") / limit).alias("ways")
    )
    dealt = (
        parts.join(hot, "anchor", "left")
        .withColumn("split", F.col("ways").isNotNull())
        .withColumn(
            "shard",
            F.pmod(
                F.xxhash64("anchor")
                + F.when(F.col("split"), F.pmod(F.xxhash64("same", "doc_id", "crc"), "ways")).otherwise(
                    F.lit(0)
                ),
                F.lit(shards),
            ),
        )
    )
    wanted = dealt.groupBy("doc_id", "crc").agg(
        F.collect_list(
            F.struct("anchor", "shard", "split", "at", start_of().alias("start"), "size")
        ).alias("wanted")
    )
    pieces = (
        join_rows(packed(docs), wanted, "inner")
        .select("doc_id", "crc", "packed", "wanted")
        .mapInArrow(lambda b: cut_parts(b, rule), PAYLOAD)
    )
    lanes = 64
    found = stored(
        pieces.groupBy("shard").applyInArrow(
            lambda t: search_shard(t, rule, search, lanes), FOUND
        ),
        "found",
    )
    merged = (
        found.where(F.col("lane").isNotNull())
        .select("anchor", "lane", "prints", "docs", "crcs", "places")
        .groupBy("anchor", "lane")
        .applyInArrow(lambda t: merge_runs(t, rule), SPAN)
    )
    return (
        found.where(F.col("lane").isNull())
        .select("doc_id", "crc", "start", "end")
        .unionByName(merged)
    )


def join_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc_id (null equals null) and crc."""
    other = right.withColumnsRenamed({"doc_id": "_doc_id", "crc": "_crc"})
    return left.join(
        other,
        left["doc_id"].eqNullSafe(other["_doc_id"]) & (left["crc"] == other["_crc"]),
        how,
    ).drop("_doc_id", "_crc")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, packed text, spans) of every document."""
    per_doc = spans.groupBy("doc_id", "crc").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    return join_rows(packed(docs), per_doc, "left").select("doc_id", "packed", "spans")
