"""The registered queries against DuckDB, and the pipeline's stages against plain Python."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quaymetrics.llm import queries
from quaymetrics.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy()))
    assert rows(got) == rows(want)


def test_every_operator_has_one_query():
    numbers = [re.match(r"op(\d+)_", n) for n in queries.QUERIES]
    assert sorted(int(m[1]) for m in numbers if m) == list(range(1, 14))
    assert "pipeline" in queries.QUERIES


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def near_groups(rows, width=5):
    sets = {}
    for i, text in rows:
        w = words(text, True)
        n = max(1, len(w) - width + 1) if w else 0
        sets[i] = {tuple(w[k : k + width]) for k in range(n)}
    boss = {i: i for i in sets}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                boss[y] = x
    return {i for i in sets if top(i) == i}


def leaked(text, items):
    cut = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)
    )
    own = " " + " ".join(cut(text)) + " "
    for item in items:
        w = cut(item)
        size = min(10, len(w))
        if size and any(
            f" {' '.join(w[k : k + size])} " in own for k in range(len(w) - size + 1)
        ):
            return True
    return False


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_001, None, "en", "src0", 0), (10_002, "12 !", "en", "src0", 4), (10_003, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    seen = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        left = {r.doc_id: r.text for r in docs.collect()}
        assert len(left) == docs.count()
        if name == "language_id":
            assert set(left) == set(seen) - {10_001, 10_002, 10_003}
        elif name == "near_dedup":
            assert set(left) == near_groups(list(seen.items()))
        elif name == "decontamination":
            assert set(left) == {i for i, t in seen.items() if not leaked(t, items)}
        else:
            assert set(left) == set(seen)
            assert all(not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in left.values())
            assert sum(left[i] != seen[i] for i in left) < len(left) / 2
        if name != "secret_scan":
            assert all(left[i] == seen[i] for i in left)
        seen = left
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    used = Counter()
    for row in mixed:
        used[row.source] += len(words(row.text))
    total = sum(len(words(t)) for t in seen.values())
    assert abs(sum(used.values()) - total) < 0.2 * total


def test_run_is_the_registered_query(spark):
    got = queries.QUERIES["pipeline"](spark, SF)
    assert {"shard", "slot", "source", "text"} <= set(got.columns) and got.count() > 0


def test_rows_of_one_id_and_clashing_columns(spark):
    """Different texts of one id are different documents; any column name passes through."""
    prose = [" ".join(f"{w}{k}" for k in range(40)) for w in ("der hund ", "the dog ", "une maison ")]
    rows = [
        (1, prose[0]), (1, prose[1]), (1, prose[1]), (2, prose[1] + " end"), (3, prose[2]), (None, prose[2]),
        (4, "password = hunter22secret"), (4, "token: abcdef123456"), (5, None),
    ]
    names = "_doc_id string, _mark int, _spans string, mark string, spans int, _key int, __key int, _least int, crc int"
    docs = spark.createDataFrame(
        [(*r, "a", 1, "b", "c", 2, 3, 4, 5, 6) for r in rows], f"doc_id long, text string, {names}"
    )
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert left == sorted(
        [(1, prose[0]), (1, prose[1]), (3, prose[2]), (None, prose[2]), *rows[6:]], key=str
    ) or left == sorted(
        [(1, prose[0]), (2, rows[3][1]), (3, prose[2]), (None, prose[2]), *rows[6:]], key=str
    )
    clean = corpus_pipeline.secret_scan(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r.text for r in clean.collect()}
    assert not any("hunter22" in (t or "") or "abcdef123456" in (t or "") for t in texts)
    assert corpus_pipeline.decontamination(spark, docs, SF).columns == docs.columns
    mixed = corpus_pipeline.source_mixing(spark, docs.withColumn("source", docs["_doc_id"]), SF)
    assert mixed.count() > 0


def test_empty_table_through_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
