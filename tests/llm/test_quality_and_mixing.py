"""Positive-unlabelled quality scores (op5) and source mixing (op7)."""

import re
from collections import defaultdict

import numpy as np
import pytest

from quaymetrics.llm import mixing, pu_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = [(-1, None), (-2, ""), (None, "a"), (None, "a")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = pu_quality.score_by_labels(rows.selectExpr("*", "1 as score"), labels).collect()
    assert len(got) == docs.count() + 4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.93
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[-1] == by_id[-2]


def test_without_positives(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (1, 1)], "doc_id long, quality int")
    assert {r.score for r in pu_quality.score_by_labels(docs, labels).collect()} == {0.5}
    assert pu_quality.score_by_labels(docs.limit(0), labels).count() == 0


def test_risk_stays_non_negative_and_separates():
    rng = np.random.default_rng(2)
    positive = rng.normal(1.0, 1.0, (400, 3))
    unlabelled = np.concatenate([rng.normal(1.0, 1.0, (600, 3)), rng.normal(-2.0, 1.0, (400, 3))])
    model = pu_quality.fit(positive, unlabelled, 0.6)
    assert model.score(np.full((1, 3), 1.5))[0] > 0.9 and model.score(np.full((1, 3), -2.5))[0] < 0.1


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(limit * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: limit * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in capped and target[s] > limit * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mix(spark, block):
    rng = np.random.default_rng(block)
    rows = [
        (i, " ".join(["w"] * int(n)), f"s{i % 5}" if i % 7 else None, 1)
        for i, n in enumerate(rng.integers(0, 60, 150))
    ]
    rows += [(1, "twice two", "s1", 1)] * 2 + [(None, "x y", "é", 1), (4, None, "s4", 1), (5, " \n", "tiny", 1)]
    rows += [(200, "big " * 5000, "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    got = mixing.Mix(docs, block=block).taken().collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    total = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size
        total[r.source_size, round(r.target, 6)] += r.taken
    assert {k for k in total} == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (size, target), taken in total.items():
        same = sum(sizes[s] == size and round(want[s], 6) == target for s in sizes)
        assert abs(taken - same * target) <= same * 2 * block
    again = mixing.Mix(docs.repartition(3), block=block).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_texts_are_the_blocks(spark):
    rows = [(i, " ".join(f"{i}.{k}" for k in range(i)), f"s{i % 3}") for i in range(30)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8)
    blocks = mix.texts().collect()
    assert len(blocks) == mix.slots.count() == len({b.slot for b in blocks})
    assert all(len(b.text.split(" ")) <= 8 for b in blocks)
    words = defaultdict(int)
    for b in blocks:
        assert all(w.split(".")[0] in map(str, b.doc_ids) for w in b.text.split(" "))
        for w in b.text.split(" "):
            words[int(w.split(".")[0])] += 1
    assert dict(words) == {r.doc_id: r.taken for r in mix.taken().collect() if r.taken}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    mix = mixing.Mix(none)
    assert mix.taken().count() == 0 and mix.texts().count() == 0
