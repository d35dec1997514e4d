"""Embedding whitening (op12) against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from quaymetrics.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def check(rows, got, components=4):
    """`rows` are (vec_id, list or None)."""
    fine = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    size = max((len(v) for _, v in fine), default=0)
    x = [(i, [math.floor(256 * float(e)) for e in v] + [0] * (size - len(v))) for i, v in fine]
    if not size:
        assert got == []
        return
    distinct = sorted({tuple(v) for _, v in x})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    a = np.array(distinct, float) - np.array(sums) / n
    covariance = a.T @ a / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, size)
    assert len(got) == k * len(fine)
    want = {}
    for i, v in x:
        deviation = sum((n * e - s) ** 2 for e, s in zip(v, sums, strict=True))
        want.setdefault(i, []).append((deviation, (np.array(v) - np.array(sums) / n) @ vectors))
    for c in range(k):
        here = [r for r in got if r.component == c + 1]
        assert all(r.n == n and r.identity_error <= 1e-4 for r in here)
        assert sorted((r.vec_id, r.deviation) for r in here) == sorted(
            (i, d) for i, ds in want.items() for d, _ in ds
        )
        if values[c] <= 1e-10 * max(values[0], 1e-300):
            assert all(r.whitened is None for r in here)
            continue
        trace = np.trace(covariance)
        assert all(abs(r.explained - values[c] / trace) <= 1e-9 for r in here)
        mine = np.array([r.whitened for r in here])
        plain = np.array([want[r.vec_id][0][1][c] for r in here]) / np.sqrt(values[c])
        flip = np.sign(mine @ plain)
        assert np.abs(mine - flip * plain).max() < 1e-7


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op12_embedding_whitening"](spark, SF).collect())


@pytest.mark.parametrize("size", [1, 2, 3, 8, 64])
def test_eigen(size):
    rng = np.random.default_rng(size)
    basis = np.linalg.qr(rng.standard_normal((size, size)))[0]
    spectra = [
        rng.uniform(0, 1, size),
        10.0 ** -np.arange(size),
        np.where(np.arange(size) < size // 2, 1.0, 0.0),
        np.ones(size),
        np.zeros(size),
        np.where(np.arange(size) < 2, 5.0, 1.0) + 1e-9 * np.arange(size),
        np.sort(rng.uniform(-1, 1, size)),
    ]
    for spectrum in spectra:
        a = (basis * spectrum) @ basis.T
        a = (a + a.T) / 2
        values, vectors = whitening.eigen(a)
        norm = max(np.linalg.norm(a), 1e-300)
        assert np.abs(values - np.sort(spectrum)[::-1]).max() <= 1e-13 * size * norm
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13 * size
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * size * norm


def test_polar_is_the_sign():
    a = np.diag([3.0, 1e-9, -1e-12, -2.0])
    assert np.allclose(whitening.polar(a), np.diag([1.0, 1, -1, -1]))


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, x int, component string, n int, whitened int"
    inf, nan = float("inf"), float("nan")

    def run(rows):
        df = spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], schema)
        return whitening.whiten(df).collect()

    rng = np.random.default_rng(2)
    rows = [(k, [float(e) for e in np.float32(rng.normal(size=5))]) for k in range(40)]
    odd = [
        (None, [0.5, -0.25, 0.0, -0.0, 1.0]), (50, None), (51, [0.1, None, 0.2, 0.3, 0.4]),
        (52, [nan, 0.1, 0.1, 0.1, 0.1]), (53, [inf, 0.0, 0.0, 0.0, 0.0]), (54, [-inf]), (55, []),
        (56, [0.5, 0.5]), rows[3], rows[3], (57, rows[3][1]),
    ]
    got = run(rows + odd)
    assert len(got) == 4 * (40 + 6)
    plain = [r for r in rows + odd if r[0] is not None]
    check([*plain, (-1, odd[0][1])], [r if r.vec_id is not None else r._replace_id() for r in map(Row, got)])
    check([(1, [0.5, 0.25])], run([(1, [0.5, 0.25])]))
    check([(1, [0.5, 0.25]), (2, [0.75, 0.5])], run([(1, [0.5, 0.25]), (2, [0.75, 0.5])]))
    check([], run([]))
    check([(1, None)], run([(1, None)]))
    check([(1, [])], run([(1, [])]))


class Row:
    """A row whose missing id can be told as -1."""

    def __init__(self, row):
        self.__dict__.update(row.asDict())

    def _replace_id(self):
        self.vec_id = -1
        return self
