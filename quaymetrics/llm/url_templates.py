"""URL filter over a tree of path templates, learned per host from the urls and from labels.

1. A path is cut at `/`; empty segments do not count. What follows the DEPTH-th segment is one tail.
2. Variable segments become wildcards of their shape ({num}, {hex}, {word}, {mix}, with a file's
   extension). A segment stays literal at its place only if at least FEWEST urls of the host and
   COMMON of those that reach this depth have it there, so a place has at most 1 / COMMON literals.
3. From the root down, branches of one node are merged when the distributions of what follows them
   and of their labels (block, allow, none) are both within ALIKE of Jensen-Shannon divergence.
4. A template is rejected when its smoothed labelled purity, (blocked + 1) / (labelled + 2), reaches
   PURE. A template without labels has 0.5 and is allowed.

Urls are counted by template before anything is joined, what a node's branches are compared by is of
a fixed size, and rows meet the tables of hosts and templates over SALTS copies of these, so that one
host or template may hold any part of the rows.

Null urls and urls without `://` have the empty host and path, which are judged like any other.
Repeated rows are judged and counted one by one. Other columns are not read. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.text import require_columns
from quaymetrics.session import forget, stored

DEPTH = 8
FEWEST, COMMON = 3, 0.01
ALIKE = 0.1
#: What follows a branch is compared over so many buckets.
BUCKETS = 32
PURE = 0.8
SALTS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host, its subdomains, and the paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, of equals the first; null if none does."""
    order = sorted(rules, key=lambda r: -len(r.name))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(order):
        fits = rule.fits(host, path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The segments of a path; those after the depth-th are put together."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    tail = F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(
        F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(tail))
    ).otherwise(parts)


def shape(segment: Column) -> Column:
    """The wildcard that a variable segment becomes."""
    ending = F.regexp_extract(segment, r"(?s)^.+(\.[A-Za-z]{1,5})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(ending))
    kind = (
        F.when(stem.rlike("^[0-9]+$"), "{num}")
        .when(stem.rlike("^[0-9A-Fa-f]{8,}$"), "{hex}")
        .when(stem.rlike("^[^0-9]+$"), "{word}")
        .otherwise("{mix}")
    )
    return F.concat(kind, ending)


def salted(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Left join in which rows of one key are dealt to SALTS tasks, for which `small` is copied.

    The dealing is by a hash of the columns `by`, so that a repeated task deals alike.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, "_salt"], "left").drop("_salt")


def literals(paths: DataFrame, fewest: int = FEWEST, common: float = COMMON) -> DataFrame:
    """(host, literals): for each host, the map of depths to segments that stay as they are."""
    counted = (
        paths.select("host", F.posexplode("segments").alias("at", "segment"), "n")
        .groupBy("host", "at", "segment")
        .agg(F.sum("n").alias("n"))
    )
    totals = counted.groupBy("host", "at").agg(F.sum("n").alias("total"))
    return (
        salted(counted.where(F.col("n") >= fewest), totals, ["host", "at"], ["segment"])
        .where(F.col("n") >= common * F.col("total"))
        .groupBy("host", "at")
        .agg(F.collect_set("segment").alias("kept"))
        .groupBy("host")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "kept"))).alias("literals"))
    )


def template(parts: Column, kept: Column) -> Column:
    """Literal segments are marked with =, so no segment can look like a wildcard."""
    none = F.array().cast("array<string>")

    def token(segment: Column, at: Column) -> Column:
        own = F.coalesce(F.try_element_at(kept, at), none)
        return F.when(F.array_contains(own, segment), F.concat(F.lit("="), segment)).otherwise(
            shape(segment)
        )

    return F.transform(parts, token)


def divergence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits between smoothed counts, along the last axis."""
    p = (a + 0.5) / (a + 0.5).sum(-1, keepdims=True)
    q = (b + 0.5) / (b + 0.5).sum(-1, keepdims=True)
    mid = (p + q) / 2
    return 0.5 * (p * np.log2(p / mid) + q * np.log2(q / mid)).sum(-1)


def classes(tokens: list[str], follow: np.ndarray, labels: np.ndarray, alike: float) -> list[str]:
    """The class of each branch of one node: its own name, or {first+} if it has more branches.

    Branches in falling order of urls join the first class that they are alike, or start one.
    """
    order = sorted(range(len(tokens)), key=lambda k: (-follow[k].sum(), tokens[k]))
    names, first_follow, first_labels, out = [], [], [], [""] * len(tokens)
    for k in order:
        near = []
        if names:
            near = np.flatnonzero(
                (divergence(np.array(first_follow), follow[k]) <= alike)
                & (divergence(np.array(first_labels), labels[k]) <= alike)
            )
        if len(near):
            out[k] = names[near[0]]
            continue
        names.append(tokens[k])
        first_follow.append(follow[k])
        first_labels.append(labels[k])
        out[k] = tokens[k]
    return [f"{{{c}+}}" if out.count(c) > 1 else c for c in out]


def merge_nodes(batches: Iterator[pa.RecordBatch], alike: float) -> Iterator[pa.RecordBatch]:
    """One row per node with its branches gives one row per branch whose class is another."""
    for batch in batches:
        rows = {"host": [], "parent": [], "token": [], "class": []}
        for k in range(batch.num_rows):
            node = batch.slice(k, 1).to_pylist()[0]
            found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for b in node["branches"]:
                follow, labels = found.setdefault(b["token"], (np.zeros(BUCKETS), np.zeros(3)))
                follow[b["bucket"]] += b["n"]
                labels += (b["blocked"], b["allowed"], b["n"] - b["blocked"] - b["allowed"])
            tokens = sorted(found)
            follow = np.array([found[t][0] for t in tokens])
            labels = np.array([found[t][1] for t in tokens])
            for token, name in zip(tokens, classes(tokens, follow, labels, alike), strict=True):
                if token != name:
                    rows["host"].append(node["host"])
                    rows["parent"].append(node["parent"])
                    rows["token"].append(token)
                    rows["class"].append(name)
        yield pa.record_batch({k: pa.array(v, pa.string()) for k, v in rows.items()})


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, "/")


def merge_branches(counted: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Adds `merged`, the template after merging, to (host, tokens, n, blocked, allowed)."""
    table = counted.withColumn("merged", F.col("tokens"))
    deepest = counted.agg(F.max(F.size("tokens"))).first()[0] or 0
    for at in range(deepest):
        parent = joined(F.slice("merged", 1, at))
        cut = table.select(
            "host",
            parent.alias("parent"),
            F.get("merged", F.lit(at)).alias("token"),
            F.pmod(
                F.xxhash64(joined(F.slice("merged", at + 2, deepest))), F.lit(BUCKETS)
            ).cast("int").alias("bucket"),
            "n",
            "blocked",
            "allowed",
        ).where(F.col("token").isNotNull())
        sums = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
        nodes = (
            cut.groupBy("host", "parent", "token", "bucket")
            .agg(*sums)
            .groupBy("host", "parent")
            .agg(
                F.collect_list(F.struct("token", "bucket", "n", "blocked", "allowed")).alias("branches"),
                F.min("token").alias("least"),
                F.max("token").alias("most"),
            )
            .where(F.col("least") != F.col("most"))
            .select("host", "parent", "branches")
        )
        moves = nodes.mapInArrow(
            lambda b: merge_nodes(b, alike), "host string, parent string, token string, class string"
        )
        keyed = table.withColumns({"parent": parent, "token": F.get("merged", F.lit(at))})
        named = F.transform(
            "merged", lambda t, i: F.when(i == at, F.coalesce("class", t)).otherwise(t)
        )
        new = stored(
            salted(keyed, moves, ["host", "parent", "token"], ["tokens"])
            .withColumn("merged", named)
            .select(*table.columns),
            "templates",
        )
        forget(table)
        table = new
    return table


def purity(blocked: Column, labelled: Column) -> Column:
    return (blocked + 1.0) / (labelled + 2.0)


def learn(paths: DataFrame, pure: float = PURE) -> tuple[DataFrame, DataFrame]:
    """From (host, segments, n, blocked, allowed): the literals of hosts and the judged templates.

    The templates are (host, tokens, merged, n, labelled, purity, rejected).
    """
    kept = stored(literals(paths), "literals")
    counted = (
        salted(paths, kept, ["host"], ["segments"])
        .withColumn("tokens", template(F.col("segments"), F.col("literals")))
        .groupBy("host", "tokens")
        .agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed")))
    )
    merged = merge_branches(stored(counted, "templates"))
    judged = merged.groupBy("host", "merged").agg(
        F.sum("blocked").alias("all_blocked"),
        (F.sum("blocked") + F.sum("allowed")).alias("labelled"),
    )
    share = purity(F.col("all_blocked"), F.col("labelled"))
    out = salted(merged, judged, ["host", "merged"], ["tokens"]).select(
        "host",
        "tokens",
        joined(F.col("merged")).alias("merged"),
        "n",
        "labelled",
        share.alias("purity"),
        (share >= pure).alias("rejected"),
    )
    return kept, stored(out, "judged")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, pure: float = PURE) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    Pages under a rule have its verdict and are the labels; the templates judge the others.
    """
    require_columns(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(
        "page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"),
        segments(F.col("path")).alias("segments"),
    )
    return judge(rows, pure).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        F.col("merged").alias("template"),
        "purity",
    )


def judge(rows: DataFrame, pure: float = PURE) -> DataFrame:
    """Adds merged, purity and rejected to rows with host, segments and ruled (block, allow, null)."""
    paths = rows.groupBy("host", "segments").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ruled") == "block").alias("blocked"),
        F.count_if(F.col("ruled") == "allow").alias("allowed"),
    )
    kept, judged = learn(stored(paths, "paths"), pure)
    own = [c for c in ("page_id", "segments") if c in rows.columns]
    placed = salted(rows, kept, ["host"], own).withColumn(
        "tokens", template(F.col("segments"), F.col("literals"))
    )
    return salted(placed.drop("literals"), judged.drop("n"), ["host", "tokens"], own)
