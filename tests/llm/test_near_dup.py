"""Near-duplicate groups (op9) against all pairs."""

import random
import re

from quaymetrics.llm import near_dup

WIDTH = 2


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    if len(w) < WIDTH:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1))


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    boss = {i: i for i in ids}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a, s in sets:
        for b, t in sets:
            both = len(s & t)
            if a < b and s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = sorted((top(a), top(b)))
                boss[y] = x
    out = []
    for i, t in rows:
        one = None if i is None else top(i)
        out.append((i, len(shingles(t)), one, i is None or i == one))
    return sorted(out, key=str)


def family(r, size, edits, words=120):
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(edits):
            copy[r.randrange(words)] = f"n{r.randrange(10**6)}"
        yield " ".join(copy)


def rows():
    r = random.Random(4)
    texts = [t for edits in (0, 1, 3, 5, 6) for t in family(r, 12, edits)]
    texts += ["", None, " \n", "One", "one", "two", "a b", "A  B", "b a", "a b c d e", "a b c d e f"]
    texts += [" ".join(f"u{r.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    r.shuffle(texts)
    out = list(enumerate(texts))
    return out + [(5, "one more row of five"), (None, texts[0]), (None, None), (out[3][0], out[3][1])]


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, bucket int"
    )


def test_components(spark):
    got = near_dup.link(table(spark, rows()), shingle=WIDTH)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows())


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "PARTNERS", 2)
    r = random.Random(8)
    # copies far enough from each other that only some pairs hold
    texts = list(enumerate(family(r, 40, 7)))
    got = near_dup.link(table(spark, texts), shingle=WIDTH)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(texts)


def test_no_rows(spark):
    assert near_dup.link(table(spark, [(1, "a")]).limit(0)).count() == 0
