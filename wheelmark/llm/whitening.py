"""Embedding whitening by exact covariances: integers cut into limbs whose float64 products are exact.

A vector becomes integers x = floor(scale * c). The fit list is each distinct x once: n of them with sums S. Everything
that is summed is an integer: y = n * x - S is centred before it is multiplied, its products are summed limb by limb with
BLAS (no sum leaves the 53 bits in which float64 is exact), limbs are put together as big integers in the task, cut into
32-bit digits and summed by Spark. The covariance is sum(y y') / n^3, rounded once.

Cases: rows whose vector is null or holds null, NaN or infinite entries are dropped. The dimension is the one that most
distinct vectors have (ties: the larger); rows of another length are dropped too. Entries beyond 64 bits are held at the
limit. Repeated rows are scored each, and counted once in the fit; null ids are carried. Directions without variance
(eigenvalue at most 1e-18 of the largest) are no components: with fewer than two distinct vectors there are no rows.
``deviation`` is null where it doesn't fit 64 bits. An empty table gives no rows. Other columns play no part. The driver
holds matrices of the dimension's size, nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelmark.llm.shared import field, picked, written

#: A limb's bits and the rows of a product: LIMB + LIMB + log2(ROWS) is 53.
LIMB, ROWS = 20, 1 << 13
#: Products of limbs that are added up as 64-bit integers before they are put together.
ADDED = 1 << 9
DIGIT = 32


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, x: rows whose vector is whole and finite."""
    rows = picked(vectors, id=id_col, v=vector_col).where("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(cast(c as double)) < double('infinity'))")
    return rows.select("id", F.expr(f"transform(v, c -> floor({scale}D * cast(c as double)))").alias("x"))


def _matrix(column: pa.Array, dim: int, wide: bool) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x.astype(object) if wide else x


# --- exact sums ---------------------------------------------------------------------------------------------------


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """``y`` (integers of count * LIMB bits with sign at most) as float64 matrices whose sum with weights 2^(k LIMB) is
    ``y``; only the last has a sign."""
    out = []
    for k in range(count):
        part = y >> (k * LIMB)
        out.append((part if k == count - 1 else part & ((1 << LIMB) - 1)).astype(np.float64))
    return out


def gram(blocks: Iterator[np.ndarray], dim: int, bits: int) -> np.ndarray:
    """The exact sum of y' y over blocks of rows whose entries are below 2^bits in size, as big integers."""
    count = max(1, -(-(bits + 1) // LIMB))
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    whole = np.zeros((dim, dim), object)
    part, added = {p: np.zeros((dim, dim), np.int64) for p in pairs}, 0

    def put_together() -> None:
        for (a, b), c in part.items():
            both = c.astype(object) if a == b else c.astype(object) + c.T.astype(object)
            whole[:] += both << ((a + b) * LIMB)
            c[:] = 0

    for block in blocks:
        for at in range(0, len(block), ROWS):
            cut = limbs(block[at : at + ROWS], count)
            for a, b in pairs:
                part[a, b] += (cut[a].T @ cut[b]).astype(np.int64)
            added += 1
            if added == ADDED:
                put_together()
                added = 0
    put_together()
    return whole


def digits(values: np.ndarray, count: int) -> list[np.ndarray]:
    """Big integers as ``count`` columns of DIGIT bits, the last with the sign."""
    out = []
    for k in range(count):
        part = values >> (k * DIGIT)
        out.append((part if k == count - 1 else part & ((1 << DIGIT) - 1)).astype(np.int64))
    return out


def _summed(rows: DataFrame, keys: list[str], count: int) -> dict[tuple, int]:
    """Sums of big integers that tasks give as digits: Spark adds the digits, the driver carries."""
    found = rows.groupBy(*keys).agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(count)]).collect()
    return {tuple(r[k] for k in keys): sum(r[f"d{k}"] << (k * DIGIT) for k in range(count)) for r in found}


@dataclass(frozen=True)
class Fit:
    """n distinct vectors, sums by dimension, bits that |n x - S| needs, and the components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    bits: int
    vectors: np.ndarray
    values: np.ndarray
    total: float

    def centred(self, column: pa.Array) -> np.ndarray:
        wide = self.bits > 62
        return _matrix(column, len(self.sums), wide) * self.n - np.array(self.sums, object if wide else np.int64)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def components(products: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) of products / n^3 and their eigenvalues, falling, ``most`` at most.

    Residuals are worked out in integers, so that a few rounds of first-order correction leave only what rounding the
    vector itself does, however far apart the eigenvalues lie.
    """
    dim, cube, unit = len(products), n**3, 1 << 60
    values, vectors = np.linalg.eigh((products / cube).astype(np.float64))
    out = []
    for k in range(dim - 1, max(dim - 1 - most, -1), -1):
        u = vectors[:, k]
        for turn in range(4):
            whole = np.array([round(float(v) * unit) for v in u], object)
            image = products @ whole
            norm, form = int(whole @ whole), int(whole @ image)
            value = form / (norm * cube)
            if turn < 3:
                left = ((image * norm - whole * form) / (norm * cube * unit)).astype(np.float64)
                gap = value - values
                close = np.abs(gap) <= 1e-13 * values[-1]
                close[k] = True
                u = u + vectors @ np.where(close, 0.0, (vectors.T @ left) / np.where(close, 1.0, gap))
                u = u / np.linalg.norm(u)
        out.append((value, u if u[np.argmax(np.abs(u))] > 0 else -u))
    out = [x for x in sorted(out, key=lambda x: -x[0]) if x[0] > 1e-18 * values[-1] and x[0] > 0]
    return np.array([u for _, u in out]).reshape(-1, dim).T, np.array([v for v, _ in out])


def fit(distinct: DataFrame, dim: int, most: int = 4) -> Fit | None:
    """``distinct`` (x: the fit list, read three times: give a written table); None where it has no component."""
    sizes = distinct.agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("x"), F.bitwise_not(F.array_min("x")))).alias("most")).first()
    n = sizes.n
    if n < 2:
        return None
    bits = int(sizes.most).bit_length() + 1 + n.bit_length()
    entry = max(1, -(-(64 + n.bit_length()) // DIGIT))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(dim, object)
        for batch in batches:
            x = _matrix(batch["x"], dim, False)
            # halves of 32 bits: a batch of them stays within 64
            whole += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), *[pa.array(d) for d in digits(whole, entry)]], names=["i", *[f"d{k}" for k in range(entry)]])

    names = ", ".join(f"d{k} long" for k in range(entry))
    sums = _summed(distinct.mapInArrow(add, f"i int, {names}"), ["i"], entry)
    start = Fit(n, tuple(sums[(i,)] for i in range(dim)), bits, np.zeros((dim, 0)), np.zeros(0), 0.0)
    product = max(1, -(-(2 * bits + n.bit_length() + 1) // DIGIT))
    low, high = np.tril_indices(dim)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = gram((start.centred(batch["x"]) for batch in batches), dim, bits)[low, high]
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32()), *[pa.array(d) for d in digits(whole, product)]], names=["i", "j", *[f"d{k}" for k in range(product)]])

    names = ", ".join(f"d{k} long" for k in range(product))
    products = np.zeros((dim, dim), object)
    for (i, j), value in _summed(distinct.mapInArrow(multiply, f"i int, j int, {names}"), ["i", "j"], product).items():
        products[i, j] = products[j, i] = value
    total = sum(int(products[i, i]) for i in range(dim)) / n**3
    vectors, values = components(products, n, most)
    return Fit(n, start.sums, bits, vectors, values, total) if len(values) else None


def identity_error(distinct: DataFrame, fitted: Fit) -> float:
    """The largest absolute entry of (the whitened fit list's covariance minus the identity): each task centres on its
    own mean, the driver merges a mean and a small matrix from each."""
    k = len(fitted.values)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, squares = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fitted.whitened(fitted.centred(batch["x"]))
            if len(w):
                n, mean, squares = merged(n, mean, squares, len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([squares.ravel().tolist()])], names=["n", "mean", "squares"])

    n, mean, squares = 0, np.zeros(k), np.zeros((k, k))
    for row in distinct.mapInArrow(spread, "n long, mean array<double>, squares array<double>").where("n > 0").toLocalIterator():
        n, mean, squares = merged(n, mean, squares, row.n, np.array(row.mean), np.array(row.squares).reshape(k, k))
    return float(np.abs(squares / n - np.eye(k)).max())


def merged(n: int, mean: np.ndarray, squares: np.ndarray, m: int, other: np.ndarray, more: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and sum of centred products of two lists together."""
    off = other - mean
    return n + m, mean + off * (m / (n + m)), squares + more + np.outer(off, off) * (n * m / (n + m))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4, scale: int = 256) -> DataFrame:
    """For each kept row and component: vec_id, component (from 1), n, deviation (the sum over dimensions of
    (n x - S)^2), whitened, explained (the eigenvalue's share of the trace) and identity_error.
    """
    rows = integers(vectors, id_col, vector_col, scale)
    kind = field(rows, "id")
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    lengths = distinct.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    fitted = None
    if lengths:
        distinct = distinct.where(F.size("x") == lengths.dim)
        fitted = fit(distinct, lengths.dim, most)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(distinct, fitted), len(fitted.values)
    shares = fitted.values / fitted.total
    exact = 2 * fitted.bits + lengths.dim.bit_length() <= 62

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = fitted.centred(batch["x"])
            m = len(y)
            if exact:
                deviation = pa.array((y * y).sum(axis=1), pa.int64())
            else:
                y = y.astype(object)
                deviation = pa.array([v if v < 1 << 63 else None for v in ((row * row).sum() for row in y)], pa.int64())
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, fitted.n)), deviation.take(pa.array(at)),
                 pa.array(fitted.whitened(y).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == lengths.dim).mapInArrow(score, schema)
