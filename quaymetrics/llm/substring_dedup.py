"""Removal of word passages that an earlier document has, by a compressed FM-index per shard.

The stretches of a shard (see repeats.py) are indexed together. Each is then streamed through the
index: backward search over the wavelet tree gives, for chosen word positions, the longest match
that ends there and stands in a document with a smaller doc_id. These matching statistics never
move back as the end moves on, so positions between two searched ones follow from them or are
searched by bisection. Passages of `length` words or more are reported.

Null texts have no words. A text of fewer than `length` words loses nothing. Of rows with the same
doc_id none is earlier than the other; rows with a null doc_id come after all others. Equal texts
all lose their passages but the one with the smallest doc_id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm import repeats
from quaymetrics.llm import text as tx
from quaymetrics.llm.fm_index import FmIndex
from quaymetrics.llm.suffix_dedup import cut_spans, removed

LENGTH = 50
GRAM = 6
#: Ends are searched at every such step first.
STRIDE = 25
RESULT = "doc_id long, n_words long, kept binary, spans array<struct<start: long, end: long>>"


class RangeLeast:
    """The least value in any range, from ranges of doubling width."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int32)]
        width = 1
        while 2 * width <= len(values):
            row = self.rows[-1]
            self.rows.append(
                np.concatenate([np.minimum(row[:-width], row[width:]), row[-width:]])
            )
            width *= 2
        self.table = np.stack(self.rows)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(float))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high - (1 << level)])


class EarlierMatches:
    """Matching statistics of the stretches of a shard against its earlier documents."""

    def __init__(self, shard: repeats.Shard):
        bounds = shard.units.bounds
        sizes = np.diff(bounds)
        alphabet, symbols = np.unique(shard.units.hash, return_inverse=True)
        self.first = bounds[:-1] + np.arange(len(sizes))  # after one end mark each
        self.text = np.zeros(int(bounds[-1]) + len(sizes), np.int64)
        self.text[tx.ranges(self.first, sizes)] = symbols + 1
        self.rank = shard.doc_rank
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.index = FmIndex(self.text, len(alphabet) + 1)
        self.least = RangeLeast(self.rank[owner][self.index.order])

    def lengths(self, end: np.ndarray, owner: np.ndarray, longest: int) -> np.ndarray:
        """Length, up to `longest`, of the longest match in an earlier document that ends there."""
        out = np.zeros(len(end), np.int64)
        low, high = self.index.whole(len(end))
        live = np.arange(len(end))
        for back in range(1, longest + 1):
            at = end[live] - back
            inside = at >= self.first[owner[live]]
            live, at = live[inside], at[inside]
            if not len(live):
                break
            a, b = self.index.extend(self.text[at], low[live], high[live])
            good = b > a
            good[good] = self.least.of(a[good], b[good]) < self.rank[owner[live[good]]]
            live = live[good]
            low[live], high[live] = a[good], b[good]
            out[live] = back
        return out


def earlier_windows(shard: repeats.Shard, rule: repeats.Rule) -> np.ndarray:
    """Which windows of the shard stand in a document with a smaller id."""
    length = rule.length
    start, owner = shard.window_starts(length)
    again = np.zeros(len(start), bool)
    if not len(start):
        return again
    matches = EarlierMatches(shard)
    # ends of windows in the marked text; consecutive windows of one stretch differ by one
    end = start + owner + length
    head = np.append(True, owner[1:] != owner[:-1])
    place = np.arange(len(start)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    tail = np.append(head[1:], True)
    chosen = np.flatnonzero((place % STRIDE == 0) | tail)
    longest = length + STRIDE
    found = np.zeros(len(start), np.int64)
    found[chosen] = matches.lengths(end[chosen], owner[chosen], longest)
    again[chosen] = found[chosen] >= length
    left, right = chosen[:-1], chosen[1:]
    keep = (owner[left] == owner[right]) & (right > left + 1)
    left, right = left[keep], right[keep]
    while len(left):
        from_left, from_right = end[left] - found[left], end[right] - found[right]
        all_in = from_right <= end[left] + 1 - length
        none_in = from_left > end[right] - 1 - length
        between = tx.ranges(left[all_in] + 1, right[all_in] - left[all_in] - 1)
        again[between] = True
        rest = ~(all_in | none_in)
        left, right = left[rest], right[rest]
        middle = (left + right) // 2
        found[middle] = matches.lengths(end[middle], owner[middle], longest)
        again[middle] = found[middle] >= length
        left, right = np.concatenate([left, middle]), np.concatenate([middle, right])
        keep = right > left + 1
        left, right = left[keep], right[keep]
    return again


def remove_passages(
    docs: DataFrame, length: int = LENGTH, shard_bytes: int = repeats.SHARD_BYTES
) -> DataFrame:
    """Per document: its words, the kept ones joined by a space, and the removed spans in words.

    Removed is each word covered by `length` consecutive words that also start in a document with
    a smaller doc_id.
    """
    tx.require_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rule = repeats.Rule(
        length, min(GRAM, length), words=True, earlier=True, shard_bytes=shard_bytes
    )
    spans = repeats.repeated_spans(docs, rule, earlier_windows)
    return repeats.with_spans(docs, spans).mapInArrow(lambda b: cut_spans(b, True), RESULT)


def passage_report(cut: DataFrame) -> DataFrame:
    """One digest row per document of remove_passages()."""
    return cut.select(
        "doc_id",
        "n_words",
        removed().alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
