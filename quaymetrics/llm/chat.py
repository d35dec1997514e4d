"""Conversations as prefix trees of tokens, for training with ancestor attention.

Conversations that share initial turns share the nodes of a tree. A tree's tokens are emitted once,
depth first; each node has its place in that stream, position ids that go on from its parent's, and
the intervals of the stream that its ancestors fill, which is all that it may attend to besides
itself. Conversations with one first turn are one tree, however many they are; its work is split by
ranges of `PACK` ids and by sums over subtrees, so that no task holds or orders a tree.

Turns are marked by control tokens. In texts and roles every `<`, `[` and backslash gets a
backslash after it, so no control string can stand in a text, and taking those away again is exact.
The loss mask covers the tokens of assistant texts and nothing else.

Null texts and roles are empty, a null conv_id is one conversation. Turns go by number, nulls first,
equal numbers by role and text; repeated rows are repeated turns. Other columns are not read. An
empty table gives empty tables. A conversation is put together in one task, as its digest needs.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymetrics.core import running_total
from quaymetrics.llm.text import require_columns
from quaymetrics.session import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PACK = 1 << 14
# fixed values: the pattern that belongs to the vocabulary, and the template's control strings
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/TEXT]")
OPEN = {"user": "[INST]", "assistant": "<s>", "system": "[SYS]"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "[/SYS]"}
TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[SYS\](?P<system>.*?)\[/SYS\]"
    r"|\[ROLE\](?P<role>.*?)\[TEXT\](?P<text>.*?)\[/TEXT\]",
    re.DOTALL,
)
ID = ["one", "two"]
LAST = (1 << 63) - 1


def escape(text: str) -> str:
    return re.sub(r"[<\[\\]", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[\\])\\", r"\1", text)


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """The byte-level encoding with the control strings after its own ids."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(
        "chat",
        pat_str=PATTERN,
        mergeable_ranks=ranks,
        special_tokens={c: len(ranks) + i for i, c in enumerate(CONTROLS)},
    )


def control_ids(vocabulary: bytes) -> dict[str, int]:
    return dict(encoding(vocabulary)._special_tokens)


def render(role: str, text: str, vocabulary: bytes) -> tuple[list[int], int, int]:
    """A turn's tokens and the part of them under the loss mask."""
    encode, control = encoding(vocabulary).encode_ordinary, control_ids(vocabulary)
    body = encode(escape(text))
    if role in OPEN:
        tokens = [control[OPEN[role]], *body, control[CLOSE[role]]]
        return tokens, *((1, 1 + len(body)) if role == "assistant" else (0, 0))
    head = [control["[ROLE]"], *encode(escape(role)), control["[TEXT]"]]
    return [*head, *body, control["[/TEXT]"]], 0, 0


def tokenize(batches: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            turns = [
                render(r, t, vocabulary)
                for r, t in zip(
                    part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True
                )
            ]
            tokens, start, end = zip(*turns, strict=True)
            yield pa.record_batch(
                [
                    *[part.column(c) for c in (*ID, "owner", "place")],
                    pa.array(tokens, pa.list_(pa.int32())),
                    pa.array(start, pa.int32()),
                    pa.array(end, pa.int32()),
                ],
                names=[*ID, "owner", "place", "tokens", "loss_start", "loss_end"],
            )


TOKENS = (
    "one long, two long, owner long, place long, "
    "tokens array<int>, loss_start int, loss_end int"
)


class Forest:
    """`turns`: which node each turn of each conversation is; `nodes`: the emitted tokens."""

    def __init__(self, conversations: DataFrame, vocabulary: str = VOCABULARY, pack: int = PACK):
        require_columns(conversations, "conv_id", "turn", "role", "text")
        self.vocabulary = Path(vocabulary).read_bytes()
        rows = conversations.select(
            F.coalesce(F.col("conv_id").cast("long"), F.lit(LAST)).alias("conv"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        order = Window.partitionBy("conv").orderBy("turn", "role", "text")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        hashes = [F.xxhash64(F.lit(s), "place", "role", "text") for s in (1, 2)]
        keyed = (
            rows.withColumn("place", F.row_number().over(order).cast("long"))
            .withColumn("one", F.bit_xor(hashes[0]).over(so_far))
            .withColumn("two", F.bit_xor(hashes[1]).over(so_far))
            .withColumn("root", F.first("one").over(so_far))
            .withColumn("part", F.floor(F.col("conv") / pack))
        )
        keyed = stored(keyed.drop("turn"), "turns")
        # nodes by the parts they are used in, so that a shared node's conversations are many tasks'
        local = keyed.groupBy(*ID, "part").agg(F.min("conv").alias("least"))
        owners = local.groupBy(*ID).agg(F.min("least").alias("owner"))
        spread = stored(local.drop("least").join(owners, ID), "owners")
        # the owner's row stands for the node
        own = keyed.join(spread, [*ID, "part"]).where("conv = owner")
        tokens = stored(
            own.select(*ID, "owner", "place", "role", "text").mapInArrow(
                lambda b: tokenize(b, self.vocabulary), TOKENS
            ),
            "tokens",
        )
        sizes = tokens.select(*ID, F.size("tokens").cast("long").alias("n_tokens"))
        sized = keyed.drop("role", "text").join(spread.join(sizes, ID), [*ID, "part"])
        paths = stored(self._paths(sized), "branches")
        tree = F.floor(F.col("branches")[0]["owner"] / pack).alias("pack")
        placed = stored(self._stream(paths, pack).select("*", tree).drop("branches"), "stream")
        #: the parts of the work that read a node, besides the node itself
        self.spread = spread.drop("owner")
        self.turns = stored(
            paths.select("conv", "place", *ID, "part", "position", "n_tokens", tree).join(
                self.spread.join(placed.select(*ID, "offset"), ID), [*ID, "part"]
            ),
            "paths",
        )
        before = Window.partitionBy("conv").orderBy("place")
        ends = F.col("offset") + F.col("n_tokens")
        broken = F.coalesce(F.col("offset") != F.col("_end"), F.lit(True))
        until = before.rowsBetween(Window.unboundedPreceding, 0)
        attended = (
            self.turns.withColumn("_end", F.lag(ends).over(before))
            .withColumn("_starts", F.collect_list(F.when(broken, F.col("offset"))).over(until))
            .withColumn("_ends", F.collect_list(F.when(broken, F.col("_end"))).over(until))
            .withColumn(
                "attends",
                F.zip_with(
                    "_starts",
                    F.concat("_ends", F.array(ends)),
                    lambda a, e: F.struct(a.alias("start"), e.alias("end")),
                ),
            )
            .select("conv", *ID, "attends")
        )
        #: tree, node, range of ids of its first conversation, offset in the tree's stream, position of the first token, what it attends to
        self.nodes = (
            placed.join(tokens.drop("owner", "place"), ID)
            .join(attended.withColumnRenamed("conv", "owner"), [*ID, "owner"])
            .select(
                "root",
                *ID,
                "pack",
                "offset",
                "position",
                "attends",
                "tokens",
                "loss_start",
                "loss_end",
            )
        )

    @staticmethod
    def _paths(turns: DataFrame) -> DataFrame:
        """Position ids, and the branches along each path that order the tree depth first.

        A node's owner is the least conversation through it. Where the owner changes a branch
        leaves an earlier conversation's path; branches come after that path, deep ones first.
        """
        order = Window.partitionBy("conv").orderBy("place")
        until = order.rowsBetween(Window.unboundedPreceding, 0)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        left = F.coalesce(F.col("owner") != F.lag("owner").over(order), F.lit(True))
        return (
            turns.withColumn("_left", left)
            .withColumn(
                "branches",
                F.collect_list(
                    F.when(
                        F.col("_left"),
                        F.struct((-F.col("place")).alias("depth"), F.col("owner").alias("owner")),
                    )
                ).over(until),
            )
            .withColumn("position", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
            .drop("_left")
        )

    @staticmethod
    def _stream(paths: DataFrame, pack: int) -> DataFrame:
        """Where each node starts in its tree's depth-first stream.

        The nodes of one owner are a chain, which is emitted whole; then come the chains that
        leave it, each with all that leaves those. A chain starts behind the chains on its path
        and, at each of these, behind what was emitted before it left. Sums over whole subtrees
        and sums in parts give that, so no task orders a tree.
        """
        own = paths.where("conv = owner")
        chains = stored(
            own.groupBy("conv").agg(
                F.sum("n_tokens").alias("length"),
                F.min("position").alias("start"),
                F.min_by("branches", "place").alias("branches"),
            ),
            "chains",
        )
        on_path = chains.select("conv", "length", F.explode("branches.owner").alias("owner"))
        totals = on_path.groupBy(F.col("owner").alias("conv")).agg(F.sum("length").alias("total"))
        last = F.element_at("branches", -1)["depth"]
        siblings = (
            chains.where(F.size("branches") > 1)
            .select("conv", F.element_at("branches", -2)["owner"].alias("parent"), last.alias("depth"))
            .join(totals, "conv")
            # digits that sort as (depth, part of the ids)
            .withColumn(
                "bucket",
                F.concat(
                    F.lpad((F.col("depth") + (1 << 40)).cast("string"), 14, "0"),
                    F.lpad((F.floor(F.col("conv") / pack) + (1 << 62)).cast("string"), 20, "0"),
                ),
            )
        )
        run = running_total(siblings, ["parent"], "bucket", ["depth", "conv"], F.col("total"), "run")
        ahead = run.select("conv", (F.col("run") - F.col("total")).alias("ahead"))
        steps = chains.select(F.col("conv").alias("owner"), F.col("length").alias("step")).join(
            ahead.withColumnRenamed("conv", "owner"), "owner", "left"
        )
        passed = on_path.select("conv", "owner", F.floor(F.col("conv") / pack).alias("part"))
        near = passed.select("owner", "part").distinct().join(steps, "owner")
        step = F.when(F.col("owner") != F.col("conv"), F.col("step")).otherwise(0)
        starts = (
            passed.join(near, ["owner", "part"])
            .groupBy("conv")
            .agg(F.sum(step + F.coalesce("ahead", F.lit(0))).alias("base"))
            .join(chains.select("conv", "start"), "conv")
        )
        return own.join(starts, "conv").select(
            "root",
            *ID,
            "owner",
            "position",
            "branches",
            (F.col("base") + F.col("position") - F.col("start")).alias("offset"),
        )

    def read_back(self) -> DataFrame:
        """Each conversation put together again from the emitted tokens and their loss mask."""
        nodes = self.nodes.select(*ID, "tokens", "loss_start", "loss_end")
        parts = self.turns.select("conv", "place", *ID, "part").join(
            self.spread.join(nodes, ID), [*ID, "part"]
        )
        whole = parts.groupBy("conv").agg(
            F.array_sort(
                F.collect_list(F.struct("place", "tokens", "loss_start", "loss_end"))
            ).alias("parts")
        )
        vocabulary = self.vocabulary
        return whole.mapInArrow(lambda b: decode(b, vocabulary), DECODED)


DECODED = (
    "conv_id long, formatted string, turns array<struct<role: string, text: string>>, loss string"
)


def decode(batches: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    to_bytes = encoding(vocabulary).decode_bytes
    for batch in batches:
        for i in range(batch.num_rows):
            parts = batch.column("parts").slice(i, 1).flatten()
            tokens = parts.field("tokens")
            start = parts.field("loss_start").to_numpy(zero_copy_only=False)
            end = parts.field("loss_end").to_numpy(zero_copy_only=False)
            ids = [x.values.to_numpy() for x in tokens]
            formatted = to_bytes(np.concatenate(ids).tolist()).decode()
            turns = []
            for m in TURN.finditer(formatted):
                kind = m.lastgroup
                role = unescape(m["role"]) if kind == "text" else kind
                turns.append({"role": role, "text": unescape(m[kind])})
            loss = [
                unescape(to_bytes(x[a:e].tolist()).decode())
                for x, a, e in zip(ids, start, end, strict=True)
            ]
            conv = batch.column("conv")[i].as_py()
            yield pa.record_batch(
                [
                    pa.array([None if conv == LAST else conv], pa.int64()),
                    pa.array([formatted]),
                    pa.array(
                        [turns], pa.list_(pa.struct({"role": pa.string(), "text": pa.string()}))
                    ),
                    pa.array(["".join(loss)]),
                ],
                names=["conv_id", "formatted", "turns", "loss"],
            )


def chat_report(read: DataFrame) -> DataFrame:
    """One digest row per conversation of Forest.read_back()."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
