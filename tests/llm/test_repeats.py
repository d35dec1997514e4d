"""Substring dedup (op1) and suffix-array dedup (op6) against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quaymetrics.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, anchor string, start int, packed string"
LATE = 1 << 62


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


def order(row):
    return tuple((x is None, x) for x in row)


def cover(n, starts, length):
    gone = np.zeros(n, bool)
    for s in starts:
        gone[s : s + length] = True
    return gone


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        hit = [k for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1]
        gone = cover(len(b), hit, length)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=order)


def brute_words(rows, length):
    texts = [(LATE if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - length + 1):
            p = tuple(w[k : k + length])
            first[p] = min(first.get(p, i), i)
    out = []
    for i, w in texts:
        hit = [k for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i]
        gone = cover(len(w), hit, length)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        digest = hashlib.sha256(kept.encode()).hexdigest()
        out.append((None if i == LATE else i, len(w), int(gone.sum()), digest))
    return sorted(out, key=order)


def byte_rows():
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.choice([0, 3, 10, 40, 90])))) for i in range(40)]
    same = [(3, None), (None, "abab" * 10), (None, "abab" * 10), (7, "a" * 300), (8, "é" * 30), (9, "")]
    return rows + same


def word_rows():
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.choice([0, 3, 10, 40, 90])))) for i in range(40)]
    same = [(3, None), (None, "a b a b " * 10), (None, "a b a b " * 10), (7, "a " * 300)]
    return rows + same + [(8, "\né " * 30), (9, "\t a\n" * 50), (41, rows[5][1]), (42, rows[5][1])]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 200])  # the small one splits anchors over shards
def test_byte_strings(spark, shard_bytes):
    cut = suffix_dedup.remove_repeats(frame(spark, byte_rows()), 8, shard_bytes)
    got = [tuple(r) for r in suffix_dedup.repeat_report(cut).collect()]
    assert sorted(got, key=order) == brute_bytes(byte_rows(), 8)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 200])
def test_word_passages(spark, shard_bytes):
    cut = substring_dedup.remove_passages(frame(spark, word_rows()), 8, shard_bytes)
    got = [tuple(r) for r in substring_dedup.passage_report(cut).collect()]
    assert sorted(got, key=order) == brute_words(word_rows(), 8)


def long_rows():
    """Copies of 448 bytes or more, the later one going on with the smaller byte; and for each a
    text that is sorted next to the copy and has its 400th byte, but is nowhere repeated."""
    r = random.Random(3)

    def some(n):
        return "".join(chr(r.randrange(97, 123)) for _ in range(n))

    rows = []
    for _ in range(12):
        tail = some(448)
        near = tail[1:201] + "!" + tail[202:440]
        copied = some(r.choice([0, 1, 60])) + tail
        rows += [some(20) + copied + "z" + some(9), some(20) + copied + "a" + some(9), some(9) + near]
    return list(enumerate([*rows, "\0" * 900, "\0" * 401 + "x"]))


@pytest.mark.parametrize("shard_bytes", [1 << 20, 4000])
def test_byte_strings_that_agree_on_more_than_their_length(spark, shard_bytes):
    cut = suffix_dedup.remove_repeats(frame(spark, long_rows()), 400, shard_bytes)
    got = [tuple(r) for r in suffix_dedup.repeat_report(cut).collect()]
    assert sorted(got, key=order) == brute_bytes(long_rows(), 400)


def test_no_rows(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_passages(none).count() == 0
