"""Building blocks shared by the operators.

All of them keep the work of one hot key spread over many tasks: totals go through
partial aggregation and scalar subqueries, and ordered computations (running totals,
ranks, quantiles) are two-level, with a small table of bucket totals in between.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quaymetrics.session import stored


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is null or zero."""
    return num.cast("double") / F.when(den != 0, den.cast("double"))


def share(flag: Column) -> Column:
    """Mean of a boolean over its known values."""
    return F.avg(flag.cast("double"))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def sum_where(value: Column, cond: Column) -> Column:
    return F.sum(F.when(cond, value))


def total(df: DataFrame, expr: Column) -> Column:
    """A whole-table aggregate as a scalar subquery: partial aggregation, one row moved."""
    return df.agg(expr.alias("total")).scalar()


def scalars(df: DataFrame) -> dict[str, Column]:
    """The columns of a one-row table through a single scalar subquery."""
    row = df.select(F.struct(*df.columns).alias("row")).scalar()
    return {c: row.getField(c) for c in df.columns}


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join in which null keys match each other; the right keys are dropped."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    cond = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys],
        F.lit(True),
    )
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def ordered(keys: Sequence[str], *order) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def rows_to_here(keys: Sequence[str], *order) -> WindowSpec:
    return ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def rows_before(keys: Sequence[str], *order) -> WindowSpec:
    return ordered(keys, *order).rowsBetween(Window.unboundedPreceding, -1)


# --- stable hashes ---------------------------------------------------------------


def hash32(*cols: str | Column, salt: str = "") -> Column:
    """32-bit integer from md5, reproducible in any engine."""
    text = F.concat_ws("|", *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(salt))), 1, 8), 16, 10).cast("bigint")


# --- two-level ordered computations ----------------------------------------------


def log_bucket(value: Column, per_octave: int = 64) -> Column:
    """Order-preserving coarse bucket of a double: a fixed number per power of two.

    The number of distinct buckets does not grow with the number of rows.
    """
    span = F.lit(1200 * per_octave)
    size = F.floor(F.log2(F.abs(value)) * per_octave).cast("bigint") + span
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def bucket_offsets(
    df: DataFrame, keys: Sequence[str], bucket: str, value: Column, out: str
) -> DataFrame:
    """Per (keys, bucket): total of `value` over all earlier buckets of the same keys."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_bucket_total"))
    return sums.select(
        *keys,
        bucket,
        F.coalesce(F.sum("_bucket_total").over(rows_before(keys, bucket)), F.lit(0)).alias(out),
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str | Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of `value` in (bucket, order), one task per (keys, bucket).

    `bucket` must not decrease along `order`.
    """
    offsets = bucket_offsets(df, keys, bucket, value, "_offset")
    inner = df.withColumn("_inner", F.sum(value).over(rows_to_here([*keys, bucket], *order)))
    return (
        join_null_safe(inner, offsets, [*keys, bucket])
        .withColumn(out, F.col("_offset") + F.coalesce(F.col("_inner"), F.lit(0)))
        .drop("_offset", "_inner")
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    hash_value: Column,
    ties: Sequence[str | Column],
    out: str = "hash_rank",
) -> DataFrame:
    """Exact row number per keys in hash order, spread over 4096 hash buckets."""
    tagged = df.withColumn("_h", hash_value).withColumn("_hb", F.shiftright("_h", 20))
    return running_total(tagged, keys, "_hb", ["_h", *ties], F.lit(1), out).drop("_h", "_hb")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: Mapping[str, float],
    per_octave: int = 64,
) -> DataFrame:
    """Exact interpolated quantiles per keys without gathering a group in one task.

    Distinct values are counted, bucketed in order, and only the few buckets that hold a
    wanted position are ordered row by row.
    """
    counts = (
        df.select(*keys, col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", log_bucket(F.col("_v"), per_octave))
    )
    sizes = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    placed = sizes.select(
        *keys,
        "_b",
        "_bn",
        F.coalesce(F.sum("_bn").over(rows_before(keys, "_b")), F.lit(0)).alias("_before"),
        F.sum("_bn").over(Window.partitionBy(*keys)).alias("_total"),
    )

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def covers(start: Column, size: Column, at: Column) -> Column:
        return (at >= start) & (at < start + size)

    wanted = reduce(
        lambda a, b: a | b,
        [
            covers(F.col("_before"), F.col("_bn"), edge(position(p)))
            for p in probs.values()
            for edge in (F.floor, F.ceil)
        ],
    )
    picked = join_null_safe(counts, placed.where(wanted), [*keys, "_b"], "inner")
    start = F.col("_before") + F.coalesce(
        F.sum("_n").over(rows_before([*keys, "_b"], "_v")), F.lit(0)
    )
    located = picked.withColumn("_start", start)
    exprs = []
    for name, p in probs.items():
        at = position(p)
        low = F.max(F.when(covers(F.col("_start"), F.col("_n"), F.floor(at)), F.col("_v")))
        high = F.max(F.when(covers(F.col("_start"), F.col("_n"), F.ceil(at)), F.col("_v")))
        frac = F.max(at - F.floor(at))
        exprs.append((low + (high - low) * frac).alias(name))
    return located.groupBy(*keys).agg(*exprs)


def table_quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[Column, Mapping[str, float]]], per_octave: int = 64
) -> dict[str, dict[str, float | None]]:
    """Exact interpolated quantiles of several columns over the whole table.

    The table is read twice: once for the rows per ordered bucket, of which there is a fixed number
    per power of two, and once for the rows of the few buckets that hold a wanted position. Only
    these counts and the found values reach the driver.
    """
    names = list(wanted)
    parts = []
    for k, name in enumerate(names):
        v = wanted[name][0].cast("double")
        parts.append(F.struct(F.lit(k).alias("m"), v.alias("v"), log_bucket(v, per_octave).alias("b")))
    rows = df.select(F.inline(F.array(*parts))).where(F.col("v").isNotNull())
    counts: dict[int, list[tuple[int, int]]] = {k: [] for k in range(len(names))}
    for r in rows.groupBy("m", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["m"]].append((r["b"], r["n"]))
    asked, hit = [], set()
    for k, name in enumerate(names):
        total_rows = sum(n for _, n in counts[k])
        for label, p in wanted[name][1].items():
            at = p * (total_rows - 1)
            for edge in {math.floor(at), math.ceil(at)} if total_rows else ():
                before = 0
                for b, n in sorted(counts[k]):
                    if edge < before + n:
                        asked.append((k, label, edge, b, edge - before))
                        hit.add((k, b))
                        break
                    before += n
    inside = reduce(
        lambda a, b: a | b,
        [(F.col("m") == k) & F.col("b").isin([b for j, b in hit if j == k]) for k in range(len(names))],
        F.lit(False),
    )
    distinct = rows.where(inside).groupBy("m", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(rows_before(["m", "b"], "v")), F.lit(0))
    placed = distinct.withColumn("start", start)
    places: dict[tuple[int, int], set[int]] = {}
    for k, _, _, b, local in asked:
        places.setdefault((k, b), set()).add(local)
    holds = reduce(
        lambda x, y: x | y,
        [
            (F.col("m") == k)
            & (F.col("b") == b)
            & reduce(
                lambda x, y: x | y,
                [(F.col("start") <= i) & (F.lit(i) < F.col("start") + F.col("n")) for i in sorted(local)],
            )
            for (k, b), local in places.items()
        ],
        F.lit(False),
    )
    values = [tuple(r) for r in placed.where(holds).select("m", "b", "v", "n", "start").collect()]

    def value_at(k: int, edge: int, label: str) -> float:
        b, local = next((x[3], x[4]) for x in asked if x[:3] == (k, label, edge))
        return next(v for m, c, v, n, s in values if (m, c) == (k, b) and s <= local < s + n)

    out: dict[str, dict[str, float | None]] = {}
    for k, name in enumerate(names):
        total_rows = sum(n for _, n in counts[k])
        out[name] = {}
        for label, p in wanted[name][1].items():
            if not total_rows:
                out[name][label] = None
                continue
            at = p * (total_rows - 1)
            low = value_at(k, math.floor(at), label)
            high = value_at(k, math.ceil(at), label)
            out[name][label] = low + (high - low) * (at - math.floor(at))
    return out


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    values: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Last right row with right_on <= left_on, per `by`; left rows are all kept.

    Only distinct left (by, date) pairs are matched, then joined back, so neither a hot key
    nor a hot date is gathered. Within the match, months are separate tasks and the value
    carried into each month comes from a table with one row per month.
    """
    by = list(by)
    payload = F.struct(*[F.col(v) for v in values])
    null_payload = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    points = left.select(*by, F.col(left_on).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    marks = right.select(*by, F.col(right_on).alias("_t"), payload.alias("_p")).where(
        F.col("_t").isNotNull()
    )
    stream = (
        points.select(*by, "_t", F.lit(1).alias("_kind"), null_payload.alias("_p"))
        .unionByName(marks.select(*by, "_t", F.lit(0).alias("_kind"), "_p"))
        .withColumn("_m", F.trunc(F.col("_t").cast("date"), "month"))
    )
    inner = stream.withColumn(
        "_in", F.last("_p", ignorenulls=True).over(rows_to_here([*by, "_m"], "_t", "_kind"))
    ).where(F.col("_kind") == 1)
    month_last = stream.groupBy(*by, "_m").agg(
        F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("_t"))).alias("_mp")
    )
    carried = month_last.select(
        *by, "_m", F.last("_mp", ignorenulls=True).over(rows_before(by, "_m")).alias("_carry")
    )
    matched = join_null_safe(inner, carried, [*by, "_m"]).select(
        *by, F.col("_t").alias(left_on), F.coalesce("_in", "_carry").alias("_hit")
    )
    joined = join_null_safe(left, matched, [*by, left_on])
    return joined.select(*left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


#: Children of a block in the search for older places.
FAN = 16


def newest_before(
    points: DataFrame, cells: DataFrame, by: Sequence[str], n: int = 1
) -> DataFrame:
    """The newest places that had started: for each distinct point (by, upto, before), `found` is
    the falling array of the n greatest places up to `upto` whose start lies before `before`.

    `cells` has one row per (by, place), places counting 1, 2, ... in each `by`, with its `start`.
    Starts that rise with the place need n rows per point. Where they do not, the rest of the
    search goes down blocks of FAN^k places with their least starts, a bounded number of rows
    per point and level.
    """
    by = list(by)
    point = [*by, "upto", "before"]
    asked = points.select(*point).where(F.col("upto") >= 1).distinct()
    # no place after `top` had started, for all later ones start later
    onward = cells.withColumn("_t", F.min("start").over(rows_to_here(by, F.desc("place"))))
    marks = onward.groupBy(*by, "_t").agg(F.max("place").alias("top"))
    tick = F.expr("interval 0.000001 seconds")
    placed = asof_backward(
        asked.withColumn("_at", F.col("before") - tick), marks, "_at", "_t", ["top"], by
    ).withColumn("top", F.least("top", "upto"))
    place = F.explode(F.sequence(F.greatest(F.col("top") - (n - 1), F.lit(1)), "top"))
    near = (
        placed.where(F.col("top").isNotNull())
        .select(*point, place.alias("place"))
        .join(cells, [*by, "place"])
        .where(F.col("start") < F.col("before"))
        .groupBy(*point)
        .agg(F.sort_array(F.collect_list("place"), False).alias("found"))
    )
    none = F.array().cast("array<int>")
    out = placed.join(near, point, "left").select(
        *point,
        F.coalesce(F.col("found").cast("array<int>"), none).alias("found"),
        F.coalesce(F.col("top") - n, F.lit(0)).cast("int").alias("left"),
    )
    out = stored(out, "newest")
    open_ = (F.size("found") < n) & (F.col("left") >= 1)
    for _ in range(n):
        if out.where(open_).isEmpty():
            break
        older = _one_older(out.where(open_), cells, by)
        joined = out.join(older, point, "left")
        grown = F.when(F.col("older").isNotNull(), F.concat("found", F.array("older")))
        out = stored(
            joined.select(
                *point,
                F.coalesce(grown, F.col("found")).alias("found"),
                F.when(open_, F.coalesce(F.col("older") - 1, F.lit(0)))
                .otherwise(F.col("left"))
                .cast("int")
                .alias("left"),
            ),
            "newest",
        )
    return out.select(*point, "found")


def _one_older(points: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(point, older): the greatest place up to `left` whose start lies before `before`."""
    point = [*by, "upto", "before"]
    most = cells.agg(F.max("place")).first()[0] or 1
    levels = 1
    while FAN**levels <= most:
        levels += 1
    low = [cells.select(*by, F.col("place").alias("block"), F.col("start").alias("low"))]
    families = []
    for _ in range(levels):
        parts = low[-1].withColumns(
            {"child": (F.col("block") % FAN).cast("int"), "block": F.expr(f"cast(block div {FAN} as int)")}
        )
        families.append(
            parts.groupBy(*by, "block").agg(F.collect_list(F.struct("child", "low")).alias("children"))
        )
        low.append(parts.groupBy(*by, "block").agg(F.min("low").alias("low")))
    blocks = reduce(
        lambda a, b: a.unionByName(b),
        [t.withColumn("level", F.lit(k)) for k, t in enumerate(low)],
    )
    # places 0 .. left are the blocks before each digit of left + 1
    end = F.col("left") + 1

    def before_digit(k: int) -> Column:
        first = (F.floor(end / FAN ** (k + 1)) * FAN).cast("int")
        digit = F.expr(f"cast((left + 1) div {FAN**k} % {FAN} as int)")
        blocks = F.when(digit > 0, F.sequence(first, first + digit - 1))
        return F.transform(
            F.coalesce(blocks, F.array().cast("array<int>")),
            lambda b: F.struct(F.lit(k).alias("level"), b.alias("block")),
        )

    prefix = F.flatten(F.array(*[before_digit(k) for k in range(levels + 1)]))
    piece = F.explode(prefix).alias("b")
    block_end = (F.col("block") + 1) * F.pow(F.lit(float(FAN)), F.col("level"))
    at = (
        points.select(*point, piece)
        .select(*point, F.col("b.level").alias("level"), F.col("b.block").alias("block"))
        .join(blocks, [*by, "level", "block"])
        .where(F.col("low") < F.col("before"))
        .groupBy(*point)
        .agg(F.max_by(F.struct("level", "block"), block_end).alias("b"))
        .select(*point, "b.*")
    )
    for k in range(levels, 0, -1):
        family = families[k - 1].withColumn("level", F.lit(k))
        fits = F.filter("children", lambda c: c["low"] < F.col("before"))
        child = F.array_max(F.transform(fits, lambda c: c["child"]))
        down = F.col("level") == k
        at = at.join(family, [*by, "level", "block"], "left").select(
            *point,
            F.when(down, k - 1).otherwise(F.col("level")).alias("level"),
            F.when(down, F.col("block") * FAN + child).otherwise(F.col("block")).alias("block"),
        )
    return at.select(*point, F.col("block").cast("int").alias("older"))


# --- small column helpers ---------------------------------------------------------


def month_index(date_col: str | Column) -> Column:
    d = col(date_col)
    return (F.year(d) * 12 + F.month(d)).cast("int")


def time_bin(ts: str | Column, minutes: int) -> Column:
    """Start of the fixed-width bin a wall-clock time falls in, as TIMESTAMP_NTZ."""
    step = minutes * 60
    seconds = F.unix_timestamp(col(ts).cast("timestamp"))
    return F.timestamp_seconds(F.floor(seconds / step) * step).cast("timestamp_ntz")


def require_none(df: DataFrame, bad: Column, message: str) -> None:
    """Fail when any row violates a contract; counts in Spark, moves one number."""
    n = df.where(bad).count()
    if n:
        raise ValueError(f"{message}: {n} row(s)")
