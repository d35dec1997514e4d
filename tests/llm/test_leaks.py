"""Benchmark decontamination (op8)."""

import re

from quaymetrics.llm import leaks
from quaymetrics.session import stored

ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "Short one"),
    (3, None),
    (4, "..."),
    (5, "The QUICK brown fox jumps over the lazy dog again"),
    (None, "nameless item here"),
]
DOCS = [
    (1, "x y The quick-brown fox: jumps over the LAZY dog again and again z", "k"),
    (2, "short, one short two one", "k"),
    (3, None, "k"),
    (4, "", None),
    (4, "short one", None),
    (None, "nameless ITEM here; short one", "k"),
    (5, "clean words only " * 50, "k"),
    (6, "é quick brown fox jumps over the lazy dog", "k"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(window):
    out = []
    for i, text, _ in DOCS:
        own, hit, names = words(text), set(), set()
        for name, item in ITEMS:
            w = words(item)
            size = min(window, len(w))
            for k in range(len(w) - size + 1) if size else ():
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == w[k : k + size]:
                        hit.update(range(at, at + size))
                        names |= {str(name)} - {"None"}
        out.append((i, len(own), len(hit), sorted(names)))
    return sorted(out, key=str)


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def found(docs, items, **options):
    report = leaks.leak_report(leaks.find_leaks(docs, items, **options))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in report.collect()), key=str)


def test_spans_and_items(spark):
    docs, items = tables(spark)
    assert found(docs, items) == brute(10)
    assert found(docs, items, window=3) == brute(3)


def test_blocks_of_items_give_the_same(spark):
    docs, items = tables(spark)
    once = docs.where("doc_id is not null and doc_id != 4")
    want = [x for x in brute(10) if x[0] not in (None, 4)]
    assert found(once, items, block_chars=30) == want


def test_blocks_of_items_treat_each_row_by_itself(spark):
    docs, items = tables(spark)
    assert found(docs, items, block_chars=30) == brute(10)
    other = spark.createDataFrame([(None, "short one", "k"), (4, DOCS[0][1], "k")], docs.schema)
    more = docs.unionByName(docs).unionByName(other)
    assert found(more, items, block_chars=30) == found(more, items)


def test_no_block_of_items_stays_in_the_plan(spark):
    docs, items = tables(spark)
    for df in (leaks.find_leaks, leaks.drop_leaks):
        plan = df(docs, items, block_chars=30)._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan


def test_blocks_of_items_leave_a_stored_table(spark):
    docs, items = tables(spark)
    docs = stored(docs, "given")
    leaks.drop_leaks(docs, items, block_chars=30)
    assert docs.count() == len(DOCS)


def test_drop_keeps_clean_rows_whole(spark):
    docs, items = tables(spark)
    for options in ({}, {"block_chars": 30}):
        left = leaks.drop_leaks(docs, items, **options)
        assert left.columns == docs.columns
        assert sorted(map(str, left.collect())) == sorted(
            map(str, docs.where("doc_id in (3, 5, 6) or text = ''").collect())
        )


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in leaks.leak_report(leaks.find_leaks(docs, items.limit(0))).collect()] == [0] * 8
