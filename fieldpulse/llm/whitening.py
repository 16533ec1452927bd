"""PCA whitening of embeddings over an exact eigen decomposition.

Entries become whole numbers, ``floor(64 * entry)``; the covariance is taken over the distinct vectors.  Sums of
entries and of their products are whole numbers and exact at any size: tasks add up blocks that doubles hold
exactly, Spark adds the tasks' sums.  The scatter matrix ``n * sum(x x') - S S'`` has one row per dimension and is all that
reaches the driver, where ``charpoly`` finds its eigenvalues and eigenvectors.  A vector is whitened as
``(n x - S) / n``, centred in whole numbers before any rounding, projected on a component and divided by the root
of its eigenvalue.

Edge cases: vectors that are null or hold null or non-finite entries are dropped, and so are vectors of another
length than the most frequent one (the longest of several); an entry beyond the whole 64-bit numbers counts as the
largest one; repeated rows and null keys are kept and whitened, repeated vectors count once in the fit; components
without variance are left out, so one distinct vector, empty vectors and an empty table give no rows; equal
eigenvalues get some orthonormal components; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import charpoly

SCALE, COMPONENTS = 64, 16
#: Rows that are multiplied at once.
BLOCK = 4096
#: What is added to the whole numbers where they are given out; it changes no result here.
ORIGIN = 1_000_000
_SUM = pa.decimal128(38, 0)


@dataclass
class Whitening:
    """``mean`` and ``components`` (one row each) of ``n`` distinct vectors; ``sums`` are exact."""

    n: int
    sums: list[int]
    shares: list[float] = field(default_factory=list)
    variances: list[float] = field(default_factory=list)
    components: list[list[float]] = field(default_factory=list)
    identity_error: float | None = None


def quantised(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, x)``: the valid vectors as whole numbers, ``ORIGIN`` not added."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = table.select(table[key].alias("key"), table[vector].cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite)
    return rows.select("key", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the entries and of their products, as Python integers."""
    d = x.shape[1]
    total, products = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(x), BLOCK):
        part = x[at: at + BLOCK]
        largest = max(abs(int(part.min())), abs(int(part.max())))
        if largest ** 2 * BLOCK < 1 << 53:
            real = part.astype(np.float64)
            total += part.sum(0).astype(object)
            products += (real.T @ real).astype(np.int64).astype(object)
        else:
            whole = part.astype(object)
            total += whole.sum(0)
            products += whole.T.dot(whole)
    return total, products


def _scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Vectors, sums, and ``n * sum(x x') - S S'``."""
    high = 1 << 64  # sums are handed over in two parts, so that any number of bits fits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if not len(x):
                continue
            n += len(x)
            s, p = _moments(x)
            total, products = total + s, products + p
        if n:
            values = [n, *total.tolist(), *[int(products[i, j]) for i in range(d) for j in range(i, d)]]
            parts = [[Decimal(int(v) // high), Decimal(int(v) % high)] for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(values)), pa.int32()), *[pa.array([p[k] for p in parts], _SUM) for k in (0, 1)]],
                ["place", "upper", "lower"])

    found = fit.mapInArrow(run, "place int, upper decimal(38,0), lower decimal(38,0)")
    rows = found.groupBy("place").agg(F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).collect()  # d * d rows
    value = {r.place: int(r.upper) * high + int(r.lower) for r in rows}
    n, sums = value.get(0, 0), [value.get(1 + i, 0) for i in range(d)]
    scatter, place = [[0] * d for _ in range(d)], d + 1
    for i in range(d):
        for j in range(i, d):
            scatter[i][j] = scatter[j][i] = n * value.get(place, 0) - sums[i] * sums[j]
            place += 1
    return n, sums, scatter


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray | None]:
    """``n x - S`` in whole numbers, and as 64-bit ones where they fit."""
    largest = max((abs(int(x.min())), abs(int(x.max()))), default=0) if x.size else 0
    if largest * n + max(map(abs, sums), default=0) < 1 << 62:
        whole = x * np.int64(n) - np.array(sums, np.int64)
        return whole, whole
    return x.astype(object) * n - np.array(sums, object), None


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    whole, _ = _centred(x, model.n, model.sums)
    real = (whole / model.n).astype(np.float64)
    return real @ np.array(model.components).T / np.sqrt(model.variances)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of ``quantised`` vectors over their distinct values, and the vectors of its length."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    vectors = vectors.where(F.size("x") == d)
    if not d:
        return Whitening(0, []), vectors
    distinct = materialise(vectors.select("x").distinct())
    n, sums, scatter = _scatter(distinct, d)
    shares, rows = charpoly.eigen(scatter, components)
    trace = sum(scatter[i][i] for i in range(d))
    model = Whitening(n, sums, shares, [s * (trace / n ** 2) for s in shares], rows)
    if rows:
        model.identity_error = _identity_error(distinct, model, d)
    return model, vectors


def _identity_error(distinct: DataFrame, model: Whitening, d: int) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity; their mean is zero."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), BLOCK):
                w = _projected(x[at: at + BLOCK], model)
                products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(products.ravel())], ["place", "value"])

    found = distinct.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    off = F.abs(F.col("value") / model.n - (F.col("place") % (k + 1) == 0).cast("double"))
    return found.agg(F.max(off)).first()[0]


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``(key, deviation, whitened)`` of ``quantised`` vectors: the exact squared length of ``n x - S`` and one entry per
    component."""
    kind = vectors.schema["key"].dataType.simpleString()
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1), d)
                whole, small = _centred(x, model.n, model.sums)
                if small is not None and int(np.abs(small).max()) ** 2 * d < 1 << 63:
                    length = (small * small).sum(1).tolist()
                else:
                    whole = whole.astype(object)
                    length = (whole * whole).sum(1).tolist()
                w = _projected(x, model)
                offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([Decimal(v) for v in length], _SUM), pa.ListArray.from_arrays(offsets, w.ravel())],
                    ["key", "deviation", "whitened"])

    if not model.components:
        return vectors.select("key", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).limit(0)
    return vectors.mapInArrow(run, f"key {kind}, deviation decimal(38,0), whitened array<double>")


def by_component(whitened: DataFrame, model: Whitening) -> DataFrame:
    """``(key, component, deviation, whitened, explained)``: one row per vector and component, numbered from 1."""
    shares: Column = F.array(*map(F.lit, model.shares)) if model.shares else F.array().cast("array<double>")
    rows = whitened.select("key", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select("key", (F.col("place") + 1).alias("component"), "deviation", "whitened",
                       F.get(shares, F.col("place")).alias("explained"))
