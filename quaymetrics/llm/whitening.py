"""Embedding whitening by spectral divide and conquer over QDWH polar decompositions.

Vectors are scaled by `SCALE` and floored to whole numbers. The fit list holds each distinct vector
once; its sums are exact, its covariance is that of centred vectors. The polar factor of the
covariance less a shift is the matrix sign function, which gives the projectors onto the eigenvectors
on both sides of the shift; each side is a smaller symmetric matrix and is split again, down to single
components. QDWH's rational iteration needs about six QR factorisations whatever the spectrum.
Only counts, d sums and d x d products reach the driver; the components go to the tasks as literals.

Rows whose vector is null or holds null or non-finite entries are dropped. Shorter vectors count as
filled up with zeros to the longest. Repeated rows and vectors are kept in the output and count once
in the fit. A component without variance has no whitened value (null) and no part in the identity
error. Entries beyond 2^55 or so raise an overflow error, and so does a deviation that is no long.
A table without usable rows gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm.text import require_columns
from quaymetrics.session import forget, stored

SCALE = 256
#: Components with less than this part of the greatest eigenvalue count as without variance.
LEAST = 1e-13
EPSILON = np.finfo(float).eps
SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
    "explained double, identity_error double"
)


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by QDWH iteration, in QR form."""
    size = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return np.eye(size)
    x = a / norm
    low = max(EPSILON, 0.9 / (np.sqrt(size) * np.linalg.norm(inverse(x), 1)))
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:size] @ q[size:].T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if abs(low - 1) < 10 * EPSILON and moved < np.cbrt(EPSILON):
            return x
    return x


def inverse(x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue
        return np.full_like(x, np.inf)


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above a shift, and k."""
    size = len(a)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.trace(a) / size * np.eye(size))
    mean = np.trace(a) / size
    shifts = [np.median(diagonal), mean, *(mean + spread * rng.uniform(-0.5, 0.5, 30) / np.sqrt(size))]
    best = None
    for shift in shifts:
        sign = polar(a - shift * np.eye(size))
        projector = (np.eye(size) + sign) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < size:
            continue
        start = projector @ rng.standard_normal((size, k))
        basis, _ = np.linalg.qr(projector @ np.linalg.qr(start)[0], mode="complete")
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = left, basis, k
        if left <= 10 * size * EPSILON * np.linalg.norm(a):
            break
    return best and best[1:]


def eigen(a: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric matrix."""
    rng = np.random.default_rng(seed)
    size = len(a)
    values, vectors = np.zeros(size), np.zeros((size, size))
    whole = np.linalg.norm(a)
    done = 0
    blocks = [np.eye(size)]
    while blocks:
        basis = blocks.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        k = len(part)
        off = np.linalg.norm(part - np.diag(np.diag(part)))
        cut = split(part, rng) if k > 1 and off > k * EPSILON * whole else None
        if cut is None:
            values[done : done + k], vectors[:, done : done + k] = np.diag(part), basis
            done += k
            continue
        turned = basis @ cut[0]
        blocks += [turned[:, : cut[1]], turned[:, cut[1] :]]
    vectors = orthonormal(vectors)
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def orthonormal(vectors: np.ndarray) -> np.ndarray:
    """Takes away what products of many bases have lost of orthogonality."""
    return vectors @ (1.5 * np.eye(len(vectors)) - 0.5 * vectors.T @ vectors)


@dataclass(frozen=True)
class Whitening:
    """The fit: n distinct vectors, their sums, eigenvalues and components (one per row)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray

    def used(self) -> list[bool]:
        top = float(self.values[0]) if len(self.values) else 0.0
        return [bool(v > LEAST * top) for v in self.values]

    def weights(self) -> np.ndarray:
        """Rows that project a centred vector onto whitened components; zero where unused."""
        root = np.where(self.used(), np.sqrt(np.maximum(self.values, 1e-300)), np.inf)
        return self.components / root[:, None]


def whole_vectors(df: DataFrame, vector: str, scale: float = SCALE) -> DataFrame:
    """The rows with a finite vector; `x` is the scaled and floored vector."""
    c = F.col(vector).cast("array<double>")
    fine = F.forall(
        c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    )
    x = F.transform(c, lambda e: F.floor(e * scale).cast("long"))
    return df.where(c.isNotNull() & fine).withColumn("x", x)


def products(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the products of centred entries over a task's rows, upper triangle."""
    total = np.zeros((len(mean), len(mean)))
    for batch in batches:
        for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
            flat = part.column(0).flatten().to_numpy(zero_copy_only=False)
            rows = flat.reshape(part.num_rows, len(mean)) - mean
            total += rows.T @ rows
    i, j = np.triu_indices(len(mean))
    yield pa.record_batch(
        {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": total[i, j]}
    )


def mean_products(rows: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance matrix of the array column of `rows`, centred at `mean`, with divisor n."""
    cells = (
        rows.mapInArrow(lambda b: products(b, mean), "i int, j int, total double")
        .groupBy("i", "j")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    out = np.zeros((len(mean), len(mean)))
    for cell in cells:
        out[cell.i, cell.j] = out[cell.j, cell.i] = cell.total / n
    return out


def fit(distinct: DataFrame, size: int, components: int | None = None) -> Whitening:
    """Fits to the long vectors of the one column `x`, all of `size` entries, each taken once."""
    n = distinct.count()
    sums = [0] * size
    for row in (
        distinct.select(F.posexplode("x").alias("at", "e")).groupBy("at").agg(F.sum("e").alias("s"))
    ).collect():
        sums[row["at"]] = row["s"]
    covariance = mean_products(distinct, np.array(sums, float) / max(1, n), max(1, n))
    values, vectors = eigen(covariance)
    return Whitening(
        n, sums, float(np.trace(covariance)), values[:components], vectors.T[:components].copy()
    )


def project(x: Column, fitted: Whitening) -> Column:
    """The array of whitened values of a long vector."""
    mean = F.array(*(F.lit(s / fitted.n) for s in fitted.sums))
    centred = F.zip_with(x, mean, lambda a, b: a - b)
    out = []
    for used, row in zip(fitted.used(), fitted.weights(), strict=True):
        weights = F.array(*(F.lit(float(v)) for v in row))
        terms = F.zip_with(centred, weights, lambda a, w: a * w)
        total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
        out.append(total if used else F.lit(None).cast("double"))
    return F.array(*out)


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the fit list's whitened covariance minus the identity."""
    used = [k for k, u in enumerate(fitted.used()) if u]
    if not used:
        return 0.0
    whitened = F.filter(project(F.col("x"), fitted), lambda v: v.isNotNull())
    rows = distinct.select(whitened.alias("w"))
    return float(np.abs(mean_products(rows, np.zeros(len(used)), fitted.n) - np.eye(len(used))).max())


def deviation(x: Column, fitted: Whitening) -> Column:
    """Sum over dimensions of (n * x - S)^2, in longs."""
    sums = F.array(*(F.lit(s).cast("long") for s in fitted.sums))
    parts = F.zip_with(x, sums, lambda a, s: a * F.lit(fitted.n).cast("long") - s)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total + p * p)


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4
) -> DataFrame:
    """Whitened values of each usable row on the first components, one row for each."""
    require_columns(df, key, vector)
    spark = df.sparkSession
    rows = whole_vectors(df.select(F.col(key).cast("long").alias("vec_id"), vector), vector)
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.select(
        "vec_id",
        F.concat("x", F.array_repeat(F.lit(0).cast("long"), size - F.size("x"))).alias("x"),
    )
    distinct = stored(rows.select("x").distinct(), "vectors")
    fitted = fit(distinct, size, components)
    error = identity_error(distinct, fitted)
    forget(distinct)
    explained = [float(v) / fitted.trace if fitted.trace else None for v in fitted.values]
    shares = F.array(*(F.lit(v).cast("double") for v in explained))
    return rows.select(
        "vec_id",
        deviation(F.col("x"), fitted).alias("deviation"),
        F.posexplode(project(F.col("x"), fitted)).alias("at", "whitened"),
    ).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
