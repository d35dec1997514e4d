"""The numpy structures inside the tasks against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from quaymetrics.llm import mixing, near_dup
from quaymetrics.llm import text as tx
from quaymetrics.llm.fm_index import FmIndex, WaveletRank
from quaymetrics.llm.suffixes import common_prefixes, refine

TEXTS = [" a  b\n", None, "", "x\x1cy zé", "a", "b", "\t\r\n ", "Ab-cÉ9_x", "one two\vthree"]


@pytest.mark.parametrize("part", [slice(0, None), slice(2, 6), slice(1, 2), slice(0, 0)])
def test_words_are_those_of_the_pattern(part):
    column = pa.array(TEXTS, pa.string())[part]
    words = tx.Words(column)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in column.to_pylist()]
    assert np.diff(words.bounds).tolist() == [len(w) for w in want]
    every = np.ones(len(words), bool)
    assert words.take(every).to_pylist() == [" ".join(w).encode() for w in want]
    flat = [w for ws in want for w in ws]
    hashes = words.hashes().tolist()
    assert len(set(hashes)) == len(set(flat)) and len(hashes) == len(flat)


def test_alphanumeric_words():
    words = tx.Words(pa.array(["Ab-cÉ9_x"], pa.string()), tx.NOT_WORD, lower=True)
    assert words.take(np.ones(len(words), bool)).to_pylist() == ["ab cÉ9 x".encode()]


def test_chunks_keep_all_rows():
    batch = pa.record_batch([pa.array(["ab" * n for n in range(20)])], names=["text"])
    for limit in (1, 17, 10_000):
        got = [t for c in tx.merged(iter([batch]), limit=limit) for t in c.column("text").to_pylist()]
        assert got == batch.column("text").to_pylist()


@pytest.mark.parametrize("n,symbols", [(1, 2), (2, 2), (40, 3), (300, 4)])
def test_suffix_order_and_prefixes(n, symbols):
    values = np.random.default_rng(n).integers(0, symbols, n)
    order, _ = refine(values, 1 << 30)
    assert order.tolist() == sorted(range(n), key=lambda i: values[i:].tolist())
    prefix = common_prefixes(values, order, 6)
    for k in range(1, n):
        a, b = order[k - 1], order[k]
        same = 0
        while same < 6 and max(a, b) + same < n and values[a + same] == values[b + same]:
            same += 1
        assert prefix[k] == same


def test_wavelet_rank_and_access():
    values = np.random.default_rng(3).integers(0, 11, 500)
    ranks = WaveletRank(values, 11)
    at = np.arange(500)
    symbol, before = ranks.access(at)
    assert symbol.tolist() == values.tolist()
    assert before.tolist() == [(values[:i] == values[i]).sum() for i in at]
    assert ranks.rank(np.full(500, 7), at).tolist() == [(values[:i] == 7).sum() for i in at]


def test_fm_index_finds_and_locates():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 5, 400)
    text[rng.integers(0, 400, 40)] = 0
    text[-1] = 0
    index = FmIndex(text, 5)
    for length in (1, 2, 5):
        starts = [i for i in range(400 - length) if text[i : i + length].min() > 0][:40]
        patterns = np.array([text[i : i + length] for i in starts])
        low, high = index.search(patterns, np.full(len(patterns), length))
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(400) if text[i : i + length].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_permutation_is_one(size):
    at = np.arange(size)
    out = mixing.permute(at, np.full(size, size), np.full(size, 9, np.uint64))
    assert sorted(out.tolist()) == at.tolist()


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:])
    sketch = lambda s: near_dup.registers(s, np.array([0, len(s)]))
    both = sketch(np.unique(np.concatenate([a, b])))
    assert (np.maximum(sketch(a), sketch(b)) == both).all()
    # the sets share a third of their union
    sizes = np.array([2000.0]), np.array([2000.0])
    assert near_dup.likely(sketch(a), sketch(b), *sizes, 0.2)[0]
    assert not near_dup.likely(sketch(a), sketch(b), *sizes, 0.5)[0]
