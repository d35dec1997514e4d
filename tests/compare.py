"""Run registered queries against DuckDB: python tests/compare.py [pattern ...] [--sf 0.01]"""

from __future__ import annotations

import argparse
import fnmatch
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v) -> object:
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item"):
        v = v.item()
        return cell(v)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        text = v.isoformat()
        return text if "T" in text else f"{text}T00:00:00"
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return v


def normalise(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    data = [pdf[c].astype(object).tolist() for c in cols]
    rows = [tuple(cell(v) for v in r) for r in zip(*data, strict=True)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def kind(dtype: str) -> str:
    d = dtype.lower()
    for k, names in {
        "int": ("int", "long", "short", "byte", "hugeint"),
        "float": ("double", "float", "decimal"),
        "time": ("timestamp",),
        "date": ("date",),
        "bool": ("bool",),
        "text": ("varchar", "string"),
    }.items():
        if any(n in d for n in names):
            return k
    return d


def compare(spark, con, q, sf_dir: str) -> str:
    df = q.run(spark, sf_dir)
    got = df.toPandas()
    sql = q.oracle()
    if sql is None:
        return f"rows {len(got)}"
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    want = con.execute(sql).fetchall()
    want = pd.DataFrame(want, columns=rel.columns, dtype=object)
    if sorted(got.columns) != sorted(want.columns):
        a, b = set(got.columns), set(want.columns)
        return f"FAIL columns spark-only={sorted(a - b)} sql-only={sorted(b - a)}"
    bad = [
        (n, t, types[n]) for n, t in df.dtypes if kind(t) != kind(types[n])
    ]
    if bad:
        return f"FAIL types {bad}"
    if len(got) != len(want):
        return f"FAIL rows spark={len(got)} sql={len(want)}"
    a, b = normalise(got), normalise(want)
    diff = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if diff:
        x, y = diff[0]
        cols = sorted(got.columns)
        cells = [(c, u, v) for c, u, v in zip(cols, x, y, strict=True) if u != v]
        return f"FAIL values {len(diff)}/{len(a)} rows, first: {cells[:4]}"
    wide = {t for t in types.values() if "HUGEINT" in t or "DECIMAL" in t}
    note = f" (oracle types {sorted(wide)})" if wide else ""
    return f"ok {len(got)} rows{note}" + (" EMPTY" if not len(got) else "")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("patterns", nargs="*", default=["*"])
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--plans", default="")
    args = ap.parse_args()
    if args.plans:
        import importlib

        sys.modules.setdefault("quaymetrics.plans", type(sys)("quaymetrics.plans")).__path__ = [
            str(Path(__file__).resolve().parents[1] / "quaymetrics" / "plans")
        ]
        for p in ["fixtures", *args.plans.split(",")]:
            importlib.import_module(f"quaymetrics.plans.{p}")
    else:
        import quaymetrics.plans  # noqa: F401
    from quaymetrics.registry import QUERIES
    from quaymetrics.session import local_session

    spark = local_session()
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    failed = 0
    for name, q in QUERIES.items():
        if not any(fnmatch.fnmatch(name, p) for p in args.patterns):
            continue
        t = time.time()
        try:
            out = compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            text = str(e).split("JVM stacktrace")[0]
            out = f"FAIL error {type(e).__name__}: {text[:900]}"
        failed += out.startswith("FAIL")
        if True:
            print(f"{name}: {out} [{time.time() - t:.1f}s]", flush=True)
    print(f"failed {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
