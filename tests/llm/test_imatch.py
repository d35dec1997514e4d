"""Document fingerprints (op4)."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from quaymetrics.llm import imatch

SF = "/root/testdata/sf0.001"


def check(docs):
    got = imatch.fingerprints(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for k, (i, text) in enumerate(rows):
        after, third = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    return got


def test_table_is_told_apart_from_its_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = check(docs)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) / len(long) > 0.9
    prints = {}
    for r in docs.join(spark.createDataFrame(got), "doc_id").collect():
        assert prints.setdefault(r.text, r.fingerprint) == r.fingerprint


@pytest.mark.parametrize("width", [1, 1024])
def test_edges(spark, monkeypatch, width):
    monkeypatch.setattr(imatch, "RANGE", width)
    rows = [(3, "a b c"), (1, None), (None, "x y z"), (9, "é" * 20), (10, ""), (70, "a b c"), (71, "q")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, mark int, signs string")
    got = {r.doc_id: r for r in check(docs)}
    assert got[3].fingerprint == got[70].fingerprint
    check(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string"))
    assert imatch.fingerprints(docs.limit(0)).count() == 0


def test_lexicon_keeps_every_term_of_the_band(spark):
    rows = [(2 * k + j, f"red{k} fox{k}") for k in range(990) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any(r.fingerprint.startswith("whole:") for r in imatch.fingerprints(docs).collect())
    slots = imatch.lexicon(docs).first()["slots"]
    assert sum(len(x) for x in slots) == 1980


def hashed(word):
    h = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_signatures(text, lexicon):
    """Subset by subset: the hash of the text's sorted lexicon terms in it."""
    kept = sorted({hashed(w) for w in text.lower().split()} & lexicon)
    out = []
    for rate in range(imatch.RATES):
        high = (256 >> rate) - 1
        low = 0 if rate == imatch.RATES - 1 else 256 >> (rate + 1)
        for cell in range(imatch.CELLS):
            own = [
                str(h)
                for h in kept
                if low <= ((h % (1 << 64)) >> 17) & 255 <= high
                and ((h % (1 << 64)) >> 25) % imatch.CELLS == cell
            ]
            out.append(hashlib.md5(" ".join(own).encode()).hexdigest()[:8] if own else None)
    return out


def plain_print(signs, text):
    if not any(signs):
        return "whole:" + hashlib.md5(text.encode()).hexdigest()
    return ".".join(s or "-" for s in signs)


def plain_likeness(a, b):
    (signs, name), (other, other_name) = a, b
    if name == other_name:
        return 1.0
    either = sum(x is not None or y is not None for x, y in zip(signs, other, strict=True))
    equal = sum(x is not None and x == y for x, y in zip(signs, other, strict=True))
    return equal / either if either else 0.0


def test_fingerprints_and_likeness_against_plain_python(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(r.choices(words, k=r.choice((0, 3, 30, 200))))) for i in range(150)]
    rows += [(200, rows[7][1]), (201, "The THE the"), (202, " ".join(words * 20)), (203, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    counts = Counter(h for _, t in texts for h in {hashed(w) for w in t.lower().split()})
    n = len(texts)
    lexicon = {
        h for h, c in counts.items()
        if max(2, imatch.RAREST * n) <= c <= max(2, imatch.COMMONEST * n)
    }
    assert lexicon

    def made(text):
        signs = plain_signatures(text, lexicon)
        return signs, plain_print(signs, text)

    got = {x.doc_id: x for x in imatch.fingerprints(docs).collect()}
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % n][1]
        third = len(text) // 3
        own, new, following = made(text), made(text[: len(text) - third] + after[:third]), made(after)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own[1], new[1])
        assert got[i].near_edited == pytest.approx(plain_likeness(own, new))
        assert got[i].near_next == pytest.approx(plain_likeness(own, following))


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = imatch.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
