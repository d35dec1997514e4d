"""Secrets in texts: plain patterns, and weak candidates linked by their complementary parts.

Plain (base) spans are always reported: assignments of six or more characters, access ids, long
hex runs. Weaker parts - user or client identifiers, loosely named secrets, endpoints - are
reported only where the other parts of a credential stand within `scope` code points: an identifier
needs a secret, a secret an identifier, an endpoint both. The interval join runs on bins of one
scope's width that hold, for each kind of part, only the first and the last start, so neither many
parts in one place nor a long document make pairs.

Spans are code points, end exclusive. Null texts are empty. Repeated rows have equal spans. Other
columns are not read. Built of SQL functions alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.text import free_name, require_columns
from quaymetrics.session import stored

VALUE = "[A-Za-z0-9+/_.=-]"
SET = r"""["']?\x20*[:=]\x20*["']?"""
# fixed patterns of the base spans
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key){SET}({VALUE}+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED = 6
# weak parts
IDENTIFIER = (
    rf"(?i:\b(?:user|username|user_?id|login|account|account_?id|client_?id|access_?id)){SET}"
    r"[A-Za-z0-9_.@-]{3,}"
)
LOOSE = rf"(?i:\b(?:pass|pwd|key|auth|credentials?|private_?key)){SET}{VALUE}{{6,}}"
ENDPOINT = (
    r"(?i:\b(?:https?|ftp|sftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://)"
    r"""[^\x20\x09-\x0D"'<>]+"""
)
KINDS = ("assign", "access", "hex", "identifier", "loose", "endpoint")
SCOPE = 200
SPAN = "array<struct<start: int, rank: int, end: int>>"


def spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost matches that do not overlap, as (start, rank of kind, end)."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    empty = F.array().cast(SPAN)

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end")
        )
        grown = F.concat(state["out"], F.array(span))
        out = grown if keep is None else F.when(keep(pair["match"]), grown).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, first, add, lambda s: s["out"])).otherwise(
        empty
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, weak): base spans and weak candidates of every text."""
    text = F.coalesce("text", F.lit(""))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGNED
    base = docs.select(
        "doc_id",
        text.alias("text"),
        F.xxhash64(text).alias("mark"),
        F.array_sort(
            F.concat(
                spans(text, ASSIGN, "assign", long_enough),
                spans(text, ACCESS, "access"),
                spans(text, HEX, "hex"),
            )
        ).alias("base"),
        text.rlike(IDENTIFIER).alias("named"),
    )
    # without an identifier nothing weak can be reported
    some = F.col("named") | F.exists("base", lambda s: s["rank"] == KINDS.index("access"))
    weak = F.when(
        some,
        F.concat(
            spans(F.col("text"), IDENTIFIER, "identifier"),
            spans(F.col("text"), LOOSE, "loose"),
            spans(F.col("text"), ENDPOINT, "endpoint"),
        ),
    ).otherwise(F.array().cast(SPAN))
    free = F.filter(
        weak,
        lambda w: ~F.exists(
            "base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])
        ),
    )
    return base.select("doc_id", "mark", "base", free.alias("weak"))


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, mark, linked): weak spans that have their complementary parts within the scope."""
    parts = scanned.where(F.size("weak") > 0).select(
        "doc_id", "mark", F.explode(F.concat("base", "weak")).alias("span")
    )
    rank = F.col("span.rank")
    role = (
        F.when(rank.isin(KINDS.index("access"), KINDS.index("identifier")), "id")
        .when(rank == KINDS.index("endpoint"), "at")
        .otherwise("secret")
    )
    parts = parts.withColumn("role", role).withColumn(
        "bin", F.floor(F.col("span.start") / scope)
    )
    near = [
        edge(F.when(F.col("role") == r, F.col("span.start"))).alias(f"{r}_{name}")
        for r in ("id", "secret")
        for name, edge in (("first", F.min), ("last", F.max))
    ]
    bins = parts.groupBy("doc_id", "mark", "bin").agg(*near)
    # each bin tells itself and both neighbours what it holds nearest to them
    told = bins.withColumn("to", F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])))
    side = F.col("to") - F.col("bin")
    around = told.groupBy("doc_id", "mark", "to").agg(
        *[
            f.alias(name)
            for r in ("id", "secret")
            for f, name in (
                (F.max(F.when(side == 1, F.col(f"{r}_last"))), f"{r}_before"),
                (F.max(F.when(side == 0, F.col(f"{r}_last"))), f"{r}_within"),
                (F.min(F.when(side == -1, F.col(f"{r}_first"))), f"{r}_after"),
            )
        ]
    )
    start = F.col("span.start")

    def close(r: str) -> Column:
        return F.coalesce(
            F.col(f"{r}_within").isNotNull()
            | (start - F.col(f"{r}_before") <= scope)
            | (F.col(f"{r}_after") - start <= scope),
            F.lit(False),
        )

    weak = parts.where(rank >= KINDS.index("identifier"))
    other = around.withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"})
    joined = weak.join(
        other,
        weak["doc_id"].eqNullSafe(other["_doc_id"])
        & (weak["mark"] == other["_mark"])
        & (weak["bin"] == other["to"]),
    )
    whole = (
        F.when(F.col("role") == "id", close("secret"))
        .when(F.col("role") == "secret", close("id"))
        .otherwise(close("id") & close("secret"))
    )
    return joined.where(whole).groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set("span")).alias("linked")
    )


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, mark, base, linked): all spans of every document; mark is the text's xxhash64."""
    require_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(scan(docs), "secrets")
    more = linked(scanned, scope).withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"})
    return scanned.join(
        more,
        scanned["doc_id"].eqNullSafe(more["_doc_id"]) & (scanned["mark"] == more["_mark"]),
        "left",
    ).select(
        "doc_id", "mark", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked")
    )


def listed(of: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            of,
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"]),
        ),
        ",",
    )


def secret_report(found: DataFrame) -> DataFrame:
    """One digest row per document of find_secrets()."""
    n = lambda kind: F.size(
        F.filter("base", lambda s: s["rank"] == KINDS.index(kind))
    ).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, by: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced; n_chars, if there, follows the text."""
    doc_id, mark, spans = (free_name(n, docs.columns) for n in ("doc_id", "mark", "spans"))
    found = find_secrets(docs, scope).where(F.size("base") + F.size("linked") > 0)
    found = found.select(
        F.col("doc_id").alias(doc_id),
        F.col("mark").alias(mark),
        F.array_sort(F.concat("base", "linked")).alias(spans),
    ).dropDuplicates([doc_id, mark])
    text = F.coalesce("text", F.lit(""))

    def step(state: Column, s: Column) -> Column:
        at = state["at"]
        new = s["start"] >= at
        piece = F.concat(
            state["out"], F.substr("text", at + 1, F.greatest(s["start"] - at, F.lit(0))), F.lit(by)
        )
        return F.struct(
            F.greatest(at, s["end"]).alias("at"),
            F.when(new, piece).otherwise(state["out"]).alias("out"),
        )

    clean = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda s: F.concat(s["out"], F.substr("text", s["at"] + 1)),
    )
    joined = docs.join(
        found,
        docs["doc_id"].eqNullSafe(found[doc_id]) & (F.xxhash64(text) == found[mark]),
        "left",
    ).withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        joined = joined.withColumn(
            "n_chars",
            F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")),
        )
    return joined.select(*docs.columns)
