"""A sample of registered queries against DuckDB; tests/compare.py runs them all."""

import duckdb
import pytest
from compare import compare, connect

import quaymetrics.plans  # noqa: F401
from quaymetrics.registry import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "A01_zone_time_panel",
    "A03_trip_moments",
    "A12_entity_events",
    "B01_folds",
    "E08_ols_two_way",
    "F05_quota_sample",
    "J06_snapshots",
    "L05_cumulative_incidence",
    "P01_normalize_source_b",
    "Q02_conservation",
    "S03_read_piped",
    "T01_assess_lines",
    "V02_latest_same_mask",
    "W11_ranked_plan",
    "X02_zone_time_stream",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SF).startswith("ok")


def test_every_query_is_named_after_a_survey_row():
    prefixes = {n.split("_")[0] for n in QUERIES}
    assert len(prefixes) == 205


# Odd lines (part key, quantity) beside the given ones: no part key; products without quantity.
ODD_LINES = {
    "given": "l_partkey, l_quantity",
    "no part key": "case when l_orderkey % 5 = 0 then null else l_partkey end as l_partkey, l_quantity",
    "no quantity": "l_partkey, case when l_partkey % 20 in (4, 9) then 0.0::double else l_quantity end as l_quantity",
}


@pytest.mark.parametrize("odd", ODD_LINES)
def test_industry_index_reads_every_series(spark, tmp_path, odd):
    con = duckdb.connect()
    lines = f"select * exclude (l_partkey, l_quantity), {ODD_LINES[odd]} from '{SF}/lineitem.parquet'"
    for name, sql in {"lineitem": lines, "supplier": f"from '{SF}/supplier.parquet'"}.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")
        con.execute(f"create view {name} as from '{tmp_path}/{name}.parquet'")
    index = QUERIES["A31_industry_index"]
    assert compare(spark, con, index, str(tmp_path)).startswith("ok")
    months = "select distinct l_partkey % 20, date_trunc('month', l_shipdate) from lineitem"
    series = con.execute(f"select count(*) from ({months} where l_partkey is not null)").fetchone()
    found = index.run(spark, str(tmp_path)).agg({"n_component_series": "sum"}).first()
    assert found == series
