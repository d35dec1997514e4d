"""Periodic runs of words (op11) against the definition."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from quaymetrics.llm import queries, runs
from quaymetrics.llm import text as tx

SF = "/root/testdata/sf0.001"


def runs_by_definition(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def expected(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_definition(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    text = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha(text),
        sha(kept),
    )


COLUMNS = (
    "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
)


def test_table(spark):
    got = {tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == {expected(r.doc_id, r.text) for r in docs}
    assert sum(r[1] > 0 for r in got) >= len(docs) // 20


def random_texts():
    """Texts over few words, with powers, powers of powers and long repeats among them."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(300):
        letters = [str(x) for x in rng.integers(0, rng.integers(1, 6) + 1, rng.integers(0, 90))]
        while rng.random() < 0.6 and len(letters) < 1500:
            unit = letters[rng.integers(0, len(letters) + 1) :][: int(rng.integers(1, 120))]
            letters = letters + unit * int(rng.integers(1, 9)) + letters[:3]
        texts.append(" ".join(letters))
    return [*texts, "a " * 3000, "a b " * 700 + "c", ("x y " * 5 + "z ") * 40]


@pytest.mark.parametrize("probes", [1 << 20, 97])
def test_random_texts(monkeypatch, probes):
    monkeypatch.setattr(runs, "PROBES", probes)
    import pyarrow as pa

    texts = random_texts()[:: 1 if probes > 97 else 6]
    words = tx.Words(pa.array(texts))
    text, start, length, period = runs.runs_of(runs.word_ids(words), words.bounds)
    got = [[] for _ in texts]
    for row in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got[row[0]].append(row[1:])
    assert got == [runs_by_definition(t.split()) for t in texts]


def test_extensions_are_exact():
    rng = np.random.default_rng(1)
    for size in (5, 31, 64, 700):
        for letters in (1, 2, 9):
            words = np.append(rng.integers(0, letters, size), letters)
            index = runs.Extensions(words)
            a, b = np.sort(rng.integers(0, size, (500, 2)), axis=1).T
            a, b = a[a < b], b[a < b]
            want = []
            for x, y in zip(a, b, strict=True):
                k = 0
                while words[x + k] == words[y + k]:
                    k += 1
                want.append(k)
            assert index.agree(a, b).tolist() == want


def test_every_shift_meets_in_the_cover():
    assert runs.SHIFTS.max() < runs.PERIOD
    assert len({(a - b) % runs.PERIOD for a in runs.COVER for b in runs.COVER}) == runs.PERIOD


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (None, "a a a a a a a"), (None, None), (4, "a a a a a"),
        (5, "a a a a a a"), (5, "a a a a a a"), (6, "a b a b a b a b\x0cc"), (7, "é ü " * 4 + " x"),
        (8, "word " * 4_000), (9, "x" * 300_000), (22, "b c d e f g h"),
        (10, "a b c " * 4 + "q " * 6 + "a b c " * 4),
    ]
    docs = spark.createDataFrame(
        [(*r, 0, "x") for r in rows], "doc_id long, text string, start long, runs string"
    )
    out = runs.run_report(runs.find_runs(docs)).collect()
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in out), key=key)
    assert got == sorted((expected(*r, plant=False) for r in rows), key=key)
    planted = runs.run_report(runs.find_runs(runs.with_planted(docs))).collect()
    got = sorted((tuple(r[c] for c in COLUMNS) for r in planted), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key)
    assert runs.run_report(runs.find_runs(docs.limit(0))).count() == 0


def test_very_long_text(spark):
    text = "a b " + "word " * 200_000 + "c d"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = runs.run_report(runs.find_runs(docs)).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 2, 200_000, 1)
    assert row.collapsed_sha256 == hashlib.sha256(b"a b word c d").hexdigest()
