"""Periodic runs of words: difference-cover extension queries driving a harmonic grid.

A run is a stretch of words of one text with smallest period q and at least max(SHORTEST, TIMES q)
words that no neighbouring word extends. In a run, the words that equal the one q further make a
stretch of a known least length, so for each q it is enough to probe a grid with that step; over
all q the grid has about n ln(n) / 3 points. A probe whose word equals the one q further is extended
both ways by an `Extensions` index: only suffixes that start at the positions of a difference cover
are sorted, two positions are moved together to the next pair of them after comparing a few words,
and a sparse table over the sorted suffixes' common prefixes gives the rest.

Words are compared as whole strings, not by hashes. A text is searched whole inside one task, with
probes in blocks; nothing moves between tasks. Null and empty texts have no words and no run. Texts
shorter than SHORTEST words have no run. Repeated rows are treated one by one; ids may be null and
are passed on. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm import text as tx
from quaymetrics.llm.suffixes import common_prefixes, refine

#: A run has at least this many words, and at least TIMES its period.
SHORTEST, TIMES = 6, 4
#: A perfect difference set: every shift modulo PERIOD is a difference of two of its members.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
#: Grid points looked at together.
PROBES = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SCHEMA = f"doc_id bigint, n_words bigint, runs {RUNS}, kept binary"


def meeting_shifts() -> np.ndarray:
    """[a, b]: the least shift that takes positions of residues a and b into the cover."""
    shifts = np.full((PERIOD, PERIOD), PERIOD, np.int32)
    for shift in range(PERIOD):
        at = np.array([(c - shift) % PERIOD for c in COVER])
        block = shifts[np.ix_(at, at)]
        shifts[np.ix_(at, at)] = np.minimum(block, shift)
    return shifts


SHIFTS = meeting_shifts()


class Extensions:
    """How far the words from two positions on agree.

    Two positions that are compared must reach different words before the sequence ends.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words)
        # a class of positions is cut into blocks of PERIOD words; its last block always ends in
        # padding, and by a different amount in each class, so no suffix runs on into the next class
        starts = np.concatenate([np.arange(c, n + 1, PERIOD) for c in COVER])
        padded = np.zeros(n + PERIOD + 1, ">u4")
        padded[:n] = words + 1
        blocks = np.lib.stride_tricks.sliding_window_view(padded, PERIOD)[starts]
        raw = np.ascontiguousarray(blocks).view(f"S{4 * PERIOD}").ravel()
        by_block = np.argsort(raw, kind="stable")
        in_order = raw[by_block]
        symbols = np.empty(len(starts), np.int64)
        symbols[by_block] = np.cumsum(np.append(False, in_order[1:] != in_order[:-1]))
        order, _ = refine(symbols, len(symbols))
        shared = common_prefixes(symbols, order, len(symbols)) * PERIOD
        self._finish(starts[order], shared)
        self.rank = np.full(n + 1, -1, np.int32)
        self.rank[starts[order]] = np.arange(len(starts))
        self.table = minima(shared.astype(np.int32))

    def _finish(self, at: np.ndarray, shared: np.ndarray) -> None:
        """Adds the words that neighbours share inside the first block that differs."""
        n = len(self.words)
        live = np.arange(1, len(at))
        while len(live):
            a, b = at[live] + shared[live], at[live - 1] + shared[live]
            inside = (a < n) & (b < n)
            live, a, b = live[inside], a[inside], b[inside]
            live = live[self.words[a] == self.words[b]]
            shared[live] += 1

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of words that agree from positions a and b on; a < b."""
        shift = SHIFTS[a % PERIOD, b % PERIOD]
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for step in range(PERIOD):
            live = live[shift[live] > step] if step else np.flatnonzero(shift > 0)
            live = live[self.words[a[live] + step] == self.words[b[live] + step]]
            if not len(live):
                break
            out[live] = step + 1
        met = np.flatnonzero(out == shift)
        x, y = self.rank[a[met] + shift[met]], self.rank[b[met] + shift[met]]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(high - low)[1] - 1
        out[met] += np.minimum(self.table[level, low], self.table[level, high - (1 << level)])
        return out


def minima(values: np.ndarray) -> np.ndarray:
    """[k, i]: the least of 2^k values from i on."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        last, half = rows[-1], 1 << (len(rows) - 1)
        row = last.copy()
        row[:-half] = np.minimum(last[:-half], last[half:])
        rows.append(row)
    return np.stack(rows)


def step_of(period: np.ndarray) -> np.ndarray:
    """Positions in a run that equal the one a period further, at least."""
    return np.maximum(SHORTEST, TIMES * period) - period


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period.

    `ids` are the words of all texts; those of text k are bounds[k] to bounds[k + 1].
    """
    sizes = np.diff(bounds)
    # parted by a word of its own before, between and after the texts
    at = bounds[:-1] + np.arange(len(sizes)) + 1
    words = np.empty(len(ids) + len(sizes) + 1, np.int64)
    marks = np.append(at - 1, len(words) - 1)
    words[marks] = (int(ids.max()) + 1 if len(ids) else 0) + np.arange(len(marks))
    words[tx.ranges(at, sizes)] = ids
    periods = np.where(sizes >= SHORTEST, sizes // TIMES, 0)
    of = np.repeat(np.arange(len(sizes)), periods)
    period = tx.ranges(np.ones(len(sizes), np.int64), periods)
    counts = -((period - sizes[of]) // step_of(period))
    forward = backward = None
    found = []
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PROBES, side="right")))
        part = slice(first, last)
        pair = np.repeat(np.arange(first, last), counts[part])
        grid = tx.ranges(np.zeros(last - first, np.int64), counts[part])
        first = last
        q = period[pair]
        a = at[of[pair]] + grid * step_of(q)
        same = words[a] == words[a + q]
        pair, q, a = pair[same], q[same], a[same]
        if not len(a):
            continue
        if forward is None:
            forward, backward = Extensions(words), Extensions(words[::-1].copy())
        right = forward.agree(a, a + q)
        left = backward.agree(len(words) - a - q, len(words) - a)
        keep = left + right >= step_of(q)
        pair, q, a, left, right = (x[keep] for x in (pair, q, a, left, right))
        text = of[pair]
        found.append(np.stack([text, a - left - at[text], left + right + q, q]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text, start, length, q = np.concatenate(found, axis=1)
    # a stretch with a smaller period too is the same stretch of that period
    order = np.lexsort((q, length, start, text))
    text, start, length, q = (x[order] for x in (text, start, length, q))
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    text, start, length, q = (x[new] for x in (text, start, length, q))
    order = np.lexsort((q, start, text))
    return tuple(x[order] for x in (text, start, length, q))


def word_ids(words: tx.Words) -> np.ndarray:
    """A number for each word, equal for equal words of the chunk."""
    if not len(words):
        return np.zeros(0, np.int64)
    lengths = words.ends - words.starts
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = words.raw[tx.ranges(words.starts, lengths)]
    strings = pa.Array.from_buffers(
        pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.merged(batches):
        words = tx.Words(batch.column("text"))
        text, start, length, period = runs_of(word_ids(words), words.bounds)
        low = words.bounds[text] + start
        again = tx.covered(low + period, low + length, len(words))
        struct = pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (start, length, period)],
            ["start", "length", "period"],
        )
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(np.diff(words.bounds), pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(cuts), struct),
                "kept": words.take(~again),
            }
        )


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, kept) of every document: runs by start and period, and the words
    that no run holds after its first period, joined by one space, as UTF-8."""
    tx.require_columns(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, SCHEMA)


def longest_first(runs: Column) -> Column:
    """The run with the greatest exponent, of equals the first, then of the smallest period; or null.

    The quotient tells exponents apart exactly up to 2^26 words.
    """
    keyed = F.transform(
        runs,
        lambda r: F.struct(
            (-r["length"] / r["period"]).alias("power"), r["start"], r["period"], r["length"]
        ),
    )
    return F.array_min(keyed)


def run_report(found: DataFrame) -> DataFrame:
    """The counts, greatest run and digests of find_runs' rows."""
    lines = F.transform(
        "runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    )
    top = found.select("*", longest_first(F.col("runs")).alias("top"))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias(
            "runs_sha256"
        ),
        F.sha2("kept", 256).alias("collapsed_sha256"),
        "n_words",
    )


def with_planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of the id, repeats a stretch from some
    word on; the others are unchanged. Documents without an id or words are unchanged."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(
        "doc_id",
        "text",
        F.when(crc % 10 == 0, words).alias("w"),
        F.floor(crc / 10).cast("long").alias("g"),
    )
    planted = F.expr("""
        transform(w, (x, i) -> if(i < g % size(w), x,
          w[cast(g % size(w) + (i - g % size(w))
            % (1 + (size(w) - g % size(w)) div (3 + g % 8)) as int)]))""")
    return chosen.select(
        "doc_id",
        F.when(F.size("w") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"),
    )
