"""Registry of runnable queries and, where one exists, the same query in ANSI SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymetrics.session import use_utc
from quaymetrics.views import Views


# Half up, with ties taken a little early so that the last bits of a sum cannot decide them.
HALF_UP = 0.501


def to_digits(c: Column, digits: int) -> Column:
    """Round to a number of decimals with the arithmetic the oracle uses too."""
    scale = 10.0**digits
    return F.floor(c.cast("double") * scale + HALF_UP) / scale + 0.0


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None = None
    digits: Mapping[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        df = self.build(Views(spark, sf_dir))
        return df.withColumns({c: to_digits(F.col(c), d) for c, d in self.digits.items()})

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        if self.digits:
            rounded = ", ".join(
                f"floor(cast({c} as double) * {10.0**d:.1f}::double + {HALF_UP}::double)"
                f" / {10.0**d:.1f}::double + 0.0::double as {c}"
                for c, d in self.digits.items()
            )
            body = f"select * replace ({rounded}) from (\n{body}\n) as q"
        return with_ctes(body)


QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """A named subquery the oracle statements may refer to."""
    CTES[name] = sql.strip()


def with_ctes(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        for dep in CTES:
            if dep != name and dep not in needed and re.search(rf"\b{dep}\b", CTES[name]):
                visit_name(dep)
        if name not in needed:
            needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{n} as (\n{CTES[n]}\n)" for n in needed)
    if body.lower().startswith("with "):
        return f"with {parts},\n{body[5:]}"
    return f"with {parts}\n{body}"


def parse_digits(spec: str) -> dict[str, int]:
    out = {}
    for item in spec.split():
        name, _, d = item.partition(":")
        out[name] = int(d) if d else 6
    return out


def query(name: str, sql: str | None = None, digits: str = ""):
    """Register a query. `digits` names the floating columns and the decimals compared."""

    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, parse_digits(digits))
        return fn

    return register
