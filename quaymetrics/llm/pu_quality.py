"""Quality scores by positive-unlabelled learning with the non-negative risk.

Trusted positives are documents that labels mark as good; the unlabelled set is drawn from all
documents. With class prior p, the risk p E+[l(f)] + max(0, E_u[l(-f)] - p E+[l(-f)]) is minimised
for the logistic loss over a linear score of a text's own shape: its bytes, words and lines. The
prior is estimated as the share of positives among the labelled rows.

The model is fitted on a sample of at most about `POSITIVES` and `UNLABELLED` documents, drawn by a
hash of the id; every document is scored over its whole text. Rows of the held-out fifth are never
learned from. Null texts count as empty and get the score of an empty text. Documents labelled both
ways and null labels are not trusted; without any positive every score is 0.5. Repeated rows are
scored alike. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm import text as tx
from quaymetrics.llm.language import held_out

POSITIVES, UNLABELLED = 6000, 12000
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
#: From this score on a document counts as good.
GOOD = 0.3
SHAPE = 13
FEATURES = 256 + SHAPE
DRAWS = 1 << 30


def features(column: pa.Array) -> np.ndarray:
    """One row per text: roots of its byte shares, and counts and shares of words and lines."""
    words = tx.Words(column)
    own = words.hashes()
    sizes = np.diff(words.offsets)
    out = np.zeros((len(sizes), FEATURES), np.float32)
    breaks = np.flatnonzero(words.raw == 10)
    at = np.searchsorted(breaks, words.offsets)
    length = words.ends - words.starts
    upper = (words.raw >= 65) & (words.raw <= 90)
    first_upper = upper[words.starts] if len(own) else np.zeros(0, bool)
    for i, size in enumerate(sizes):
        if not size:
            continue
        raw = words.raw[words.offsets[i] : words.offsets[i + 1]]
        counts = np.bincount(raw, minlength=256)
        out[i, :256] = np.sqrt(counts / size)
        mine = own[words.bounds[i] : words.bounds[i + 1]]
        n = len(mine)
        if not n:
            continue
        span = length[words.bounds[i] : words.bounds[i + 1]]
        lines = at[i + 1] - at[i] + 1
        letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
        pairs = mine[1:] * np.uint64(31) + mine[:-1]
        out[i, 256:] = (
            np.log1p(size),
            np.log1p(n),
            np.log1p(lines),
            span.mean(),
            span.std(),
            len(np.unique(mine)) / n,
            len(np.unique(pairs)) / max(1, n - 1),
            n / lines / 50.0,
            letters / size,
            counts[65:91].sum() / max(1, letters),
            first_upper[words.bounds[i] : words.bounds[i + 1]].mean(),
            counts[48:58].sum() / size,
            (mine[1:] == mine[:-1]).mean() if n > 1 else 0.0,
        )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk by Adam steps over the whole sample."""
    mean = unlabelled.mean(axis=0)
    scale = np.maximum(unlabelled.std(axis=0), 1e-3)
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float64) for x in (positive, unlabelled))
    weight, bias = np.zeros(p.shape[1]), 0.0
    moment, energy = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        fp, fu = p @ weight + bias, u @ weight + bias
        # slopes of log(1 + exp(-f)) and log(1 + exp(f))
        up_p, down_p, down_u = sigmoid(fp) - 1.0, sigmoid(fp), sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        slope_n = np.append(
            down_u @ u / len(u) - prior * (down_p @ p) / len(p), down_u.mean() - prior * down_p.mean()
        )
        slope_p = prior * np.append(up_p @ p / len(p), up_p.mean())
        # below zero the negative part is pushed back up instead
        slope = slope_p + slope_n if negative >= 0 else -slope_n
        slope[:-1] += RIDGE * weight
        moment = 0.9 * moment + 0.1 * slope
        energy = 0.999 * energy + 0.001 * slope**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(energy / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return Model(mean, scale, weight, float(bias), prior)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tx.merged(batches):
        rows = [x.tobytes() for x in features(chunk.column("text"))]
        yield pa.record_batch(
            [chunk.column("kind"), pa.array(rows, pa.binary())], names=["kind", "row"]
        )


def score_rows(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for chunk in tx.merged(batches):
        if model is None:
            score = np.full(chunk.num_rows, 0.5)
        else:
            score = model.score(features(chunk.column("text")))
        yield pa.record_batch(
            [chunk.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"]
        )


def draw() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model | None:
    """Fit on (doc_id, text) and labels (doc_id, quality), neither with held-out rows."""
    trusted = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
        .where("least = most")
        .select("doc_id", F.col("most").cast("int").alias("quality"))
    )
    known = trusted.agg(
        F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count("*").alias("all")
    ).first()
    n = docs.count()
    if not known["good"] or not n:
        return None
    if prior is None:
        prior = min(0.95, max(0.05, (known["good"] + 1) / (known["all"] + 2)))
    share_p, share_u = min(1.0, POSITIVES / known["good"]), min(1.0, UNLABELLED / n)
    cut = lambda share: F.lit(int(share * DRAWS))
    good = trusted.where((F.col("quality") == 1) & (draw() < cut(share_p))).select("doc_id")
    positive = docs.where(draw() < cut(share_p)).join(good, "doc_id").withColumn("kind", F.lit(1))
    unlabelled = docs.where(draw() < cut(share_u)).withColumn("kind", F.lit(0))
    sample = (
        positive.select("kind", "text")
        .unionByName(unlabelled.select("kind", "text"))
        .mapInArrow(feature_rows, "kind int, row binary")
        .toArrow()
    )
    rows = np.frombuffer(b"".join(sample["row"].to_pylist()), np.float32).reshape(-1, FEATURES)
    kind = sample["kind"].to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    return fit(rows[kind == 1], rows[kind == 0], prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each document."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: score_rows(b, model), "doc_id long, score double"
    )


def score_by_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from rows that are not held out, and score all of them."""
    tx.require_columns(docs, "doc_id", "text")
    tx.require_columns(labels, "doc_id", "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
