"""Near-duplicate documents by SetSketch registers, banded, estimated jointly, then verified.

A document's set is its distinct shingles of `shingle` words, ASCII lower case; with fewer words
the whole sequence is one shingle. Documents with equal sets are one node. Each node's sketch holds
exponentially spaced truncated minima; bands of registers give buckets of candidates.

1. In each bucket all nodes are paired with the smallest one, so pairs grow with rows.
2. The pairs' similarity is estimated by joint likelihood of the registers and the exact set sizes;
   pairs far below the threshold go, the rest is verified on the full sets.
3. Buckets whose nodes are still in several components are compared block against block: likely
   pairs of different components are verified there on the full sets, each pair in the first band
   that it shares, and one link to each component is emitted. So no link is lost that any band has
   caught, and large groups of copies make no rows of pairs.

Null texts and texts without words have an empty set, are linked with nothing and kept. Rows that
share a doc_id are one document. Rows with a null doc_id are never linked, have a null component
and are kept. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm import text as tx
from quaymetrics.llm.components import components
from quaymetrics.llm.repeats import packed, unpacked
from quaymetrics.session import stored

SHINGLE = 5
THRESHOLD = (80, 100)
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
#: Spacing, rate and largest value of the registers.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 2
#: Standard errors that an estimate may lie below the threshold.
SLACK = 4.0
#: Nodes of one bucket in one task, and partners of one node.
BLOCK, PARTNERS = 512, 128
SKETCH = "doc_id long, n_shingles long, one long, two long, sketch binary"
_FACTORS = (tx.mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(
    np.uint32
) | np.uint32(1)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    words = tx.Words(column, tx.SPACES, lower=True)
    own = words.hashes()
    n = np.diff(words.bounds)
    total = np.full(len(own), 0x243F6A8885A308D3, np.uint64)
    for k in range(width):
        ahead = own[k:]
        total[: len(ahead)] = tx.mix64(total[: len(ahead)] * np.uint64(0x9E3779B97F4A7C15) + ahead)
    sets = []
    for i, size in enumerate(n):
        a = words.bounds[i]
        if size >= width:
            sets.append(np.unique(total[a : a + size - width + 1]))
        elif size:
            whole = np.uint64(size)
            for h in own[a : a + size]:
                whole = tx.mix64(np.array([whole ^ h]))[0]
            sets.append(np.array([whole]))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds


def registers(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers of each non-empty set, one row per text."""
    least = np.full((len(bounds) - 1, REGISTERS), 0xFFFFFFFF, np.uint32)
    short = (tx.mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a in range(0, len(short), 512):
        value = short[a : a + 512, None] * _FACTORS[None, :]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        value ^= value >> np.uint32(13)
        who = owner[a : a + 512]
        head = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        part = np.minimum.reduceat(value, head, axis=0)
        least[who[head]] = np.minimum(least[who[head]], part)
    rate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    level = np.floor(1.0 - np.log(rate) / np.log(BASE)) + 20000.0
    return np.clip(level, 0, LARGEST + 1).astype(np.uint16)


def sketch_texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for chunk in tx.merged(batches):
        shingles, bounds = shingle_sets(chunk.column("text"), width)
        sizes = np.diff(bounds)
        ran = [
            np.concatenate([[np.uint64(0)], np.cumsum(tx.mix64(shingles ^ np.uint64(salt)))])
            for salt in (0x13198A2E03707344, 0x24F31D4A09B82299)
        ]
        sums = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in ran]
        sketch = registers(shingles, bounds)
        yield pa.record_batch(
            [
                chunk.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(sums[0]),
                pa.array(sums[1]),
                pa.array([s.tobytes() if n else None for s, n in zip(sketch, sizes)], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "one", "two", "sketch"],
        )


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, band, node) for every band of every sketch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16)
        bands = raw.reshape(n, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :], (n, BANDS)).copy()
        for k in range(ROWS):
            key = tx.mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
        yield pa.record_batch(
            [
                pa.array(key.reshape(-1).view(np.int64)),
                pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)),
                pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)),
            ],
            names=["bucket", "band", "node"],
        )


def likely(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, at_least: float
) -> np.ndarray:
    """Whether the joint likelihood of two sketches peaks at a similarity of `at_least` or more.

    The likelihood is concave in the similarity, so the sign of its slope there tells.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - above - below
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    j = np.minimum(at_least, np.minimum(u / v, v / u) * (1 - 1e-9))
    c = (BASE - 1.0) / BASE
    log_base = np.log(BASE)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0.0) * c) / log_base

    def slope(x: np.ndarray) -> np.ndarray:
        return c / ((1.0 - x * c) * log_base)

    x, y = u - v * j, v - u * j
    p, q = np.maximum(chance(x), 1e-300), np.maximum(chance(y), 1e-300)
    dp, dq = -v * slope(x), -u * slope(y)
    rest = np.maximum(1.0 - p - q, 1e-300)
    gradient = above * dp / p + below * dq / q - equal * (dp + dq) / rest
    return (gradient >= 0) & (np.minimum(size_a, size_b) >= 0.999 * at_least * np.maximum(size_a, size_b))


def floor_of(threshold: tuple[int, int]) -> float:
    t = threshold[0] / threshold[1]
    return max(0.0, t - SLACK * float(np.sqrt(t * (1 - t) / REGISTERS)))


def size_ok(threshold: tuple[int, int]) -> Column:
    part, whole = threshold
    return F.least("size_a", "size_b") * whole >= F.greatest("size_a", "size_b") * part


def likely_pairs(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for n in ("sketch_a", "sketch_b")
        )
        size_a, size_b = (batch.column(n).to_numpy().astype(float) for n in ("size_a", "size_b"))
        keep = likely(a, b, size_a, size_b, at_least) if len(a) else np.zeros(0, bool)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted set `own` each of the other sets has."""
    out = np.zeros(len(others), np.int64)
    done = 0
    while done < len(others):
        sizes = np.array([len(x) for x in others[done:]])
        n = max(1, int(np.searchsorted(np.cumsum(sizes), 1 << 20)))
        every = np.concatenate(others[done : done + n])
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        hit = np.concatenate([[0], np.cumsum(own[at] == every)])
        ends = np.cumsum(sizes[:n])
        out[done : done + n] = hit[ends] - hit[ends - sizes[:n]]
        done += n
    return out


def compare_block(
    table: pa.Table, width: int, threshold: tuple[int, int], at_least: float
) -> pa.Table:
    """Links of one block: strangers (side 0) with the main component or each other (side 1)."""
    table = table.combine_chunks()
    node, group = table["node"].to_numpy(), table["component"].to_numpy()
    side, band = table["side"].to_numpy(), table["band"].to_numpy()
    raw = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16)
    sketch = raw.reshape(-1, REGISTERS)
    shingles, bounds = shingle_sets(unpacked(table["packed"].combine_chunks()), width)
    sets = [shingles[a:e] for a, e in zip(bounds[:-1], bounds[1:], strict=True)]
    size = np.diff(bounds).astype(float)
    part, whole = threshold
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    other = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        pick = other[group[other] != group[i]]
        # a pair belongs to the first band that it shares
        earlier = (sketch[pick, : ROWS * band[i]] == sketch[i, : ROWS * band[i]]).reshape(
            len(pick), band[i], ROWS
        )
        pick = pick[~earlier.all(axis=2).any(axis=1)]
        if not len(pick):
            continue
        mine = np.broadcast_to(sketch[i], (len(pick), REGISTERS))
        pick = pick[likely(mine, sketch[pick], np.full(len(pick), size[i]), size[pick], at_least)]
        both = shared(sets[i], [sets[k] for k in pick])
        pick = pick[whole * both >= part * (size[i] + size[pick] - both)]
        _, first = np.unique(group[pick], return_index=True)
        out_a.append(np.full(len(first), node[i]))
        out_b.append(node[pick[first]])
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def verify(table: pa.Table, width: int, threshold: tuple[int, int]) -> pa.Table:
    """The pairs of one node (role 0) with its partners (role 1) that hold on the full sets."""
    shingles, bounds = shingle_sets(unpacked(table["packed"].combine_chunks()), width)
    role, doc = table["role"].to_numpy(), table["node"].to_numpy()
    sets = [shingles[bounds[i] : bounds[i + 1]] for i in range(len(doc))]
    out = []
    part, whole = threshold
    partners = np.flatnonzero(role == 1)
    for i in np.flatnonzero(role == 0):
        both = shared(sets[i], [sets[k] for k in partners])
        for k, n in zip(partners, both, strict=True):
            if whole * n >= part * (len(sets[i]) + len(sets[k]) - n):
                out.append((doc[i], doc[k]))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def confirmed(
    texts: DataFrame, pairs: DataFrame, width: int, threshold: tuple[int, int]
) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a text goes to each of its partners."""
    ways = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("ways"))
    dealt = pairs.join(ways, "a").withColumn("way", F.pmod(F.xxhash64("b"), "ways"))
    roles = dealt.select(F.col("b").alias("_doc"), F.col("a").alias("key"), "way", F.lit(1).alias("role"))
    hubs = ways.select(
        F.col("a").alias("_doc"),
        F.col("a").alias("key"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("way"),
        F.lit(0).alias("role"),
    )
    sent = texts.hint("merge").join(roles.unionByName(hubs), F.col("_doc") == texts["node"])
    return (
        sent.select("key", "way", "role", "node", "packed")
        .groupBy("key", "way")
        .applyInArrow(lambda t: verify(t, width, threshold), "a long, b long")
    )


def link(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and whether it stays."""
    tx.require_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at_least = floor_of(threshold)
    sketched = stored(docs.mapInArrow(lambda b: sketch_texts(b, shingle), SKETCH), "sketches")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    same = ["one", "two", "n_shingles"]
    # a document's rows are one: its set names the class, the class names the node
    classes = usable.groupBy(*same).agg(
        F.min("doc_id").alias("node"), F.count("*").alias("rows")
    )
    members = stored(usable.select("doc_id", *same).join(classes, same), "members")
    nodes = stored(
        usable.join(
            members.where("doc_id = node").select("doc_id", *same).distinct(), ["doc_id", *same]
        )
        .select(F.col("doc_id").alias("node"), "n_shingles", "one", "two", "sketch")
        .dropDuplicates(["node", "one", "two"]),
        "nodes",
    )
    banded = nodes.select("node", "sketch").mapInArrow(
        band_keys, "bucket long, band int, node long"
    )
    buckets = banded.groupBy("bucket").agg(
        F.min("node").alias("hub"), F.count("*").alias("n")
    ).where("n > 1")
    rows = stored(banded.join(buckets, "bucket"), "buckets")
    star = rows.where("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    side = nodes.select("node", F.col("n_shingles").alias("size"), "sketch")

    def named(x: str) -> DataFrame:
        return side.select(
            F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")
        )

    tried = stored(
        star.join(named("b").hint("merge"), "b")
        .join(named("a").hint("merge"), "a")
        .where(size_ok(threshold))
        .select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
        .mapInArrow(lambda x: likely_pairs(x, at_least), "a long, b long"),
        "star",
    )
    # the texts that may be compared; each moves once, whatever the number of its partners
    involved = rows.select("node").distinct()
    own = packed(docs).withColumnRenamed("doc_id", "node")
    texts = stored(own.hint("merge").join(involved, "node").select("node", "packed"), "texts")
    held = stored(confirmed(texts, tried, shingle, threshold), "links")
    twins = members.where("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    labels = components(held)
    # buckets that still hold several components
    marked = rows.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
        "bucket", "band", "node", F.coalesce("component", "node").alias("component")
    )
    mixed = (
        marked.groupBy("bucket")
        .agg(
            F.min("component").alias("main"),
            F.max("component").alias("_last"),
            F.count("*").alias("n"),
        )
        .where("main != _last and n > 2")
        .drop("_last")
    )
    left = stored(marked.join(mixed, "bucket"), "mixed")
    found = (
        placed_blocks(left)
        .join(nodes.select("node", "sketch").hint("merge"), "node")
        .join(texts.hint("merge"), "node")
        .groupBy("bucket", "i", "j")
        .applyInArrow(
            lambda t: compare_block(t, shingle, threshold, at_least), "a long, b long"
        )
    )
    links = held.unionByName(stored(found, "more"))
    final = components(links.unionByName(twins))
    return (
        sketched.select("doc_id", "n_shingles")
        .join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


def placed_blocks(left: DataFrame) -> DataFrame:
    """The rows of mixed buckets in cells (i, j) of a block of strangers or main rows each."""
    stranger = F.col("component") != F.col("main")
    blocks = left.groupBy("bucket").agg(
        F.ceil(F.count(F.when(~stranger, 1)) / BLOCK).alias("main_blocks"),
        F.ceil(F.count(F.when(stranger, 1)) / BLOCK).alias("other_blocks"),
    )
    placed = left.join(blocks, "bucket").withColumn("hash", F.xxhash64("node"))
    main_block, other_block = (
        F.pmod("hash", F.greatest(c, F.lit(1))) for c in ("main_blocks", "other_blocks")
    )
    zero = F.lit(0).cast("long")
    cell = lambda i, j, s: F.struct(
        i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(s).alias("side")
    )
    upto = F.sequence(zero, F.col("other_blocks") - 1)
    # main rows stand in their block once for each block of strangers, as the compared side
    mains = F.transform(upto, lambda j: cell(main_block, j, 1))
    against = F.when(
        F.col("main_blocks") > 0,
        F.transform(
            F.sequence(zero, F.greatest(F.col("main_blocks"), F.lit(1)) - 1),
            lambda i: cell(i, other_block, 0),
        ),
    ).otherwise(F.array().cast("array<struct<i: bigint, j: bigint, side: int>>"))
    # strangers among themselves: cells (-1 - i, j), i not after j
    among = F.flatten(
        F.transform(
            upto,
            lambda j: F.when(
                j == other_block,
                F.array(cell(-1 - other_block, other_block, 0), cell(-1 - other_block, other_block, 1)),
            )
            .when(j > other_block, F.array(cell(-1 - other_block, j, 0)))
            .otherwise(F.array(cell(-1 - j, other_block, 1))),
        )
    )
    return placed.select(
        "bucket",
        "band",
        "node",
        "component",
        F.explode(F.when(stranger, F.concat(against, among)).otherwise(mains)).alias("cell"),
    ).select("bucket", "band", "node", "component", "cell.*")
