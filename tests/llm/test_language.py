"""Language identification (op10): exact sums over segmentations, and held-out accuracy."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quaymetrics.llm import language

SF = "/root/testdata/sf0.001"


def total(word, probability):
    """Summed probability of all segmentations, by recursion."""
    ways = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        ways[end] = sum(ways[a] * probability.get(word[a:end], 0.0) for a in range(end))
    return ways[-1]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    alphabet = [bytes([b]) for b in range(256)]
    names = sorted({*alphabet, b" a", b"ab", b"bab", b"abba", b" abbabbab", b"\xc3\xa9"})
    table = rng.random((len(names), 2))
    table /= table.sum(axis=0)
    words = [b" abba", b"bab", b" \xc3\xa9ab", b" abbabbabab", b"x"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    lattice = language.Lattice(raw, np.array([len(w) for w in words]), language.Pieces(names))
    got = lattice.forward(table)[lattice.last]
    for k in range(2):
        own = dict(zip(names, table[:, k], strict=True))
        assert got[:, k] == pytest.approx([total(w, own) for w in words])
    # expected uses weighted by length give back the length of each word
    use = lattice.expected(table[:, 0], np.ones(len(words)))
    assert (use * [len(n) for n in names]).sum() == pytest.approx(len(raw))


def test_long_words_are_cut_at_characters():
    words, begins = language.word_parts(pa.array(["é" * 50 + " b", "a" * 70, None]))
    lengths = words.ends - words.starts
    assert lengths.max() <= language.LONGEST_WORD + 3 and lengths.sum() == 100 + 1 + 70
    assert begins.sum() == 3
    assert all(words.raw[s] & 0xC0 != 0x80 for s in words.starts)


def test_model_grows_likelier():
    names = language.Pieces([bytes([b]) for b in range(256)] + [b" the"])
    counted = pd.DataFrame({"lang": "x", "word": [b" the", b" a"], "n": [10, 3]})
    fitted = language.fit_language(counted, names, 5).set_index("piece")["probability"]
    assert fitted.sum() == pytest.approx(1) and fitted.idxmax() == 256


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, "en"), (-2, "", None), (-3, "12 34 !?", "fr"), (-4, "the of and " * 3000, None)]
    odd += [(None, "the and of that", None), (None, "the and of that", None)]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    rows = rows.selectExpr("*", "1 as score", "'x' as lang_pred")
    got = language.identify_by_labels(rows).collect()
    assert len(got) == rows.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (-1, -2, -3))
    assert by_id[-4].lang_pred == "en"
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_without_labels_everything_is_unknown(spark):
    rows = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify_by_labels(rows).collect()] == ["und"]
    assert language.identify_by_labels(rows.limit(0)).count() == 0
