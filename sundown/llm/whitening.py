"""Whitening of embeddings from exact, bit-sliced cross-products.

1. An entry c becomes the whole number x = floor(64 * c) + 1000000. The fit list is each distinct
   x vector once, so copies don't weigh.
2. Less its dimension's smallest value, x is a short unsigned number u. Blocks of rows are turned
   into bit planes: plane b of a dimension holds bit b of all rows of the block, 64 rows a word. A
   cross-product of two dimensions is the sum over their planes of 2^(a+b) times the number of
   ones in the AND of plane a and plane b. A plane of ones stands for the constant 1, so the
   same products give the sums of the dimensions and the number of rows.
3. Tasks emit these sums, one row per pair of dimensions; they are added up as integers. What
   reaches the driver depends on the number of dimensions only.
4. n * (sum of u_i u_j) - S_i S_j is exact in whole numbers and is divided by n^2 once; then eigh.

Rows whose vector is null or holds a null or non-finite entry, or one beyond 2^60, which no long
could carry further, take no part. Of vectors of different lengths the length that most rows have
counts (ties: the longer), the others take no part. Repeated rows and null ids stay rows of the
result. Without rows there is no result; a direction without variance has no whitened value
(null) and explains 0. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.session import cut_lineage

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 60)  # of a scaled entry
BLOCK_ROWS = 4_096  # rows whose planes are held at once
WEIGHT_BITS = 16  # products whose weights share the higher bits are summed in one long


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``low`` and ``sums`` (of x - low) per dimension, unit directions as columns."""

    n: int
    low: tuple[int, ...]
    high: tuple[int, ...]
    sums: tuple[int, ...]
    variances: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float


def scaled(vector: str) -> Column:
    """x of every entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def usable(vector: str) -> Column:
    """No null, no non-finite entry (NaN is larger than any number), nothing beyond what a long carries."""
    held = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LARGEST, F.lit(False)))
    return F.coalesce(held, F.lit(False)) & (F.size(vector) > 0)


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v")).filter(usable("v"))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "size")).alias("m")).first()["m"]
    return rows.filter(F.size("v") == F.lit(most["size"] if most else 0)).select("vec_id", scaled("v").alias("x"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = high = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"), len(batch.column("x")[0]))
            least, most = x.min(axis=0), x.max(axis=0)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], ["i", "low", "high"])


def bit_planes(u: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """One row of words per plane, dimension after dimension, from the lowest bit; 64 rows of ``u`` a word."""
    rows = -(-len(u) // 64) * 64
    planes = np.zeros((int(widths.sum()), rows // 64), np.uint64)
    at = 0
    for i, width in enumerate(widths):
        for b in range(int(width)):
            bits = np.zeros(rows, np.uint8)
            bits[: len(u)] = (u[:, i] >> np.uint64(b)) & np.uint64(1)
            planes[at] = np.packbits(bits, bitorder="little").view("<u8")
            at += 1
    return planes


def plane_products(planes: np.ndarray, widths: np.ndarray, totals: np.ndarray) -> None:
    """Add the weighted ones of all plane pairs to ``totals[weight group, i, j]`` for j >= i."""
    owner = np.repeat(np.arange(len(widths)), widths)
    bit = np.concatenate([np.arange(w) for w in widths])
    for p in range(len(planes)):
        first = int(np.searchsorted(owner, owner[p]))
        ones = np.bitwise_count(planes[first:] & planes[p]).sum(axis=1, dtype=np.int64)
        weight = bit[first:] + bit[p]
        np.add.at(totals, (weight // WEIGHT_BITS, owner[p], owner[first:]), ones << (weight % WEIGHT_BITS))


def _products(low: tuple[int, ...], high: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last "dimension" is the constant 1.
        widths = np.array([max(1, (b - a).bit_length()) for a, b in zip(low, high, strict=True)] + [1])
        count = len(widths)
        totals = np.zeros((2 * int(widths.max()) // WEIGHT_BITS + 1, count, count), np.int64)
        least = np.array(low, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), count - 1)
            for start in range(0, len(x), BLOCK_ROWS):
                u = (x[start : start + BLOCK_ROWS] - least).astype(np.uint64)
                plane_products(bit_planes(np.column_stack([u, np.ones(len(u), np.uint64)]), widths), widths, totals)
        group, i, j = np.nonzero(totals)
        if len(group):
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(group.astype(np.int32)), pa.array(totals[group, i, j])],
                ["i", "j", "weight", "total"],
            )

    return run


def cross_products(fit_list: DataFrame, low: tuple[int, ...], high: tuple[int, ...]) -> list[list[int]]:
    """Exact sums of u_i u_j over the rows of (x), u = x - low; the last index is the constant 1."""
    parts = fit_list.select("x").mapInArrow(_products(low, high), "i int, j int, weight int, total bigint")
    found = [[0] * (len(low) + 1) for _ in range(len(low) + 1)]
    for r in parts.groupBy("i", "j", "weight").agg(F.sum("total").alias("total")).collect():  # bounded by the dimensions
        found[r["i"]][r["j"]] += r["total"] << (WEIGHT_BITS * r["weight"])
    for i in range(len(found)):
        for j in range(i):
            found[i][j] = found[j][i]
    return found


def _projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Exact deviations (null-able, objects) and whitened rows; each row's result is its own, whatever its batch."""
    least, sums = np.array(model.low, np.int64), np.array(model.sums, dtype=object)
    reach = max((model.n * (b - a) for a, b in zip(model.low, model.high, strict=True)), default=0)
    if reach * reach * max(len(sums), 1) < 1 << 63:
        off = model.n * (x - least) - sums.astype(np.int64)
        deviation = (off * off).sum(axis=1).astype(object)
    else:
        off = model.n * (x - least).astype(object) - sums
        deviation = np.array([d if d < 1 << 63 else None for d in (off * off).sum(axis=1)], dtype=object)
    # Integers beyond 2^53 are divided as such, so the quotient is rounded once.
    centred = (off / model.n).astype(np.float64)
    spread = np.sqrt(np.where(model.variances > 0, model.variances, np.inf))
    axes = model.directions / spread
    white = np.zeros((len(x), axes.shape[1]))
    for d in range(axes.shape[0]):
        white += centred[:, d : d + 1] * axes[d]
    return deviation, white


def _white_products(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = model.directions.shape[1]
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                _, white = _projected(_matrix(batch.column("x"), len(model.low)), model)
                held = np.column_stack([white, np.ones(len(white))])
                total += held.T @ held
        i, j = np.divmod(np.arange(total.size, dtype=np.int32), np.int32(size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "total"])

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (x), a column of whole-number vectors of one length; None without rows."""
    fit_list = cut_lineage(vectors.select("x").distinct())
    ranges = fit_list.mapInArrow(_ranges, "i int, low bigint, high bigint").groupBy("i").agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    ).orderBy("i").collect()  # one row a dimension
    if not ranges:
        return None
    low, high = tuple(r["low"] for r in ranges), tuple(r["high"] for r in ranges)
    products = cross_products(fit_list, low, high)
    *sums, n = products[-1]
    size = len(low)
    covariance = np.array(
        [[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(size)] for i in range(size)], np.float64
    )
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order]
    # One sign for all rows and runs: the largest entry is positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    trace = float(np.trace(covariance))
    # Below the rounding of the covariance itself a variance is none.
    variances = np.where(values[order] > max(values.max(), 0) * size * np.finfo(float).eps, values[order], 0.0)
    model = Whitening(n, low, high, tuple(sums), variances, axes, variances / trace if trace > 0 else variances, 0.0)
    return Whitening(n, low, high, tuple(sums), variances, axes, model.explained, _identity_error(fit_list, model))


def _identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, over directions with variance."""
    size = model.directions.shape[1]
    total = np.zeros((size + 1, size + 1))
    parts = fit_list.mapInArrow(_white_products(model), "i int, j int, total double")
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # components squared
        total[r["i"], r["j"]] = r["total"]
    mean = total[-1, :-1] / model.n
    covariance = total[:-1, :-1] / model.n - np.outer(mean, mean)
    varied = model.variances > 0
    off = np.abs(covariance - np.eye(size))[np.ix_(varied, varied)]
    return float(off.max()) if off.size else 0.0


def _rows(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = model.directions.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            deviation, white = _projected(_matrix(batch.column("x"), len(model.low)), model)
            varied = np.broadcast_to(model.variances > 0, white.shape)
            at = np.repeat(np.arange(batch.num_rows), size)
            component = np.tile(np.arange(1, size + 1, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at)), pa.array(component), pa.array(np.full(len(at), model.n, np.int64)),
                    pa.array(list(deviation), pa.int64()).take(pa.array(at)), pa.array(white.ravel(), mask=~varied.ravel()),
                    pa.array(model.explained[component - 1]), pa.array(np.full(len(at), model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per taking-part row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation``, the sum of (n * x - S)^2, is null where it passes a long.
    """
    rows = whole_vectors(df, vec_id, vector)
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return rows.mapInArrow(_rows(model), SCHEMA)
