"""Whitening of vectors by exact integer statistics.

Entries become integers. A task shifts every dimension to start at zero, packs
each bit of each dimension across its rows into 64-bit words (a bit plane), and
counts the common bits of any two planes; weighted by their powers of two, the
counts are the exact cross-products of the dimensions. Sums over all tasks are
integers of any size, so the scatter matrix is centred without rounding before
its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.vectors import floored, usable_rows

SCALE = 64
COMPONENTS = 32
# Rows whose bit planes are packed together; planes hold rows * entries * bits / 8 bytes.
BLOCK_ROWS = 1 << 16
# Bits of a plane's weight that one exact product of doubles takes: 16 + 16 + log2(BLOCK_ROWS) < 53.
_LIMB = 16
_WORD = 1 << 64
_WHOLE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Scatter:
    """Row count, sum of every dimension, and sum of the products of any two, exact."""

    n: int
    sums: list[int]
    products: list[list[int]]


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension, bit) of unsigned (rows, dimensions): one row of 64-bit words for each bit of a dimension."""
    rows = len(values)
    words = -(-rows // 64)
    most = values.max(axis=0)
    planes, dims, bits = [np.zeros((0, words), np.uint64)], [], []
    for bit in range(int(most.max()).bit_length()):
        wide = np.flatnonzero(most >> np.uint64(bit))
        ones = ((values[:, wide] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        packed = np.zeros((len(wide), words * 8), np.uint8)
        packed[:, : -(-rows // 8)] = np.packbits(ones, axis=0).T
        planes.append(packed.view(np.uint64))
        dims += wide.tolist()
        bits += [bit] * len(wide)
    return np.concatenate(planes), np.array(dims, np.int64), np.array(bits, np.int64)


def block_products(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of signed (rows, dimensions), at most BLOCK_ROWS rows, as Python integers."""
    least = values.min(axis=0)
    # Modulo 2^64 the difference is right however far apart the values lie.
    planes, dims, bits = bit_planes(values.view(np.uint64) - least.view(np.uint64))
    common = np.zeros((len(planes), len(planes)))
    for i in range(len(planes)):
        common[i, i:] = np.bitwise_count(planes[i:] & planes[i]).sum(axis=1, dtype=np.int64)
    common += np.triu(common, 1).T
    size = values.shape[1]
    limbs = []
    for low in range(0, int(bits.max(initial=-1)) + 1, _LIMB):
        own = np.flatnonzero((bits >= low) & (bits < low + _LIMB))
        weight = np.zeros((size, len(planes)))
        weight[dims[own], own] = 2.0 ** (bits[own] - low)
        limbs.append((low, weight))
    sums = np.zeros(size, object)
    products = np.zeros((size, size), object)
    whole = lambda x: x.astype(np.int64).astype(object)
    for low, weight in limbs:
        sums += whole(weight @ np.diag(common)) << low
        for other, second in limbs:
            products += whole(weight @ common @ second.T) << (low + other)
    start, n = least.astype(object), len(values)
    shifted = np.multiply.outer(start, sums)
    products += shifted + shifted.T + n * np.multiply.outer(start, start)
    return sums + n * start, products


def scatter(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> Scatter:
    """Statistics of floor(scale * entry) over all usable vectors; a row for each pair of dimensions reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, held = 0, 0, 0, []

        def fold():
            nonlocal n, sums, products, held
            values = np.concatenate(held)
            for at in range(0, len(values), BLOCK_ROWS):
                own = block_products(values[at : at + BLOCK_ROWS])
                sums, products = sums + own[0], products + own[1]
            n, held = n + len(values), []

        for batch in batches:
            if batch.num_rows:
                held.append(floored(batch.column(0), scale))
                if sum(map(len, held)) >= BLOCK_ROWS:
                    fold()
        if held:
            fold()
        if n:
            size = len(sums)
            # Pairs of dimensions, then the sums as pairs with a column of ones, which is dimension `size`.
            left, right = np.triu_indices(size)
            i = np.concatenate([left, np.arange(size), [size]])
            j = np.concatenate([right, np.full(size + 1, size)])
            totals = [*products[left, right], *sums, n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(i), size), pa.int32()),
                    pa.array(i, pa.int32()),
                    pa.array(j, pa.int32()),
                    pa.array([Decimal(int(t) // _WORD) for t in totals], _WHOLE),
                    pa.array([Decimal(int(t) % _WORD) for t in totals], _WHOLE),
                ],
                ["size", "i", "j", "high", "low"],
            )

    parts = usable_rows(df, vec_id, vector).select("vec").mapInArrow(run, "size int, i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("size", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    if not rows:
        return Scatter(0, [], [])
    size = rows[0].size
    if any(r.size != size for r in rows):
        raise ValueError("vectors of several lengths in one table")
    total = {(r.i, r.j): int(r.high) * _WORD + int(r.low) for r in rows}
    products = [[total[min(i, j), max(i, j)] for j in range(size)] for i in range(size)]
    return Scatter(total[size, size], [total[i, size] for i in range(size)], products)


@dataclass(frozen=True)
class Basis:
    """Columns of `axes` turn a centred vector into whitened components; `explained` is each one's share of all variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]


def basis(stats: Scatter, components: int = COMPONENTS) -> Basis:
    """Leading eigenvectors over the root of their eigenvalue, without directions in which nothing varies."""
    n, sums = stats.n, stats.sums
    if not n:
        return Basis(0, [], np.zeros((0, 0)), [])
    # n^2 times the covariance, in integers; the quotient of two integers is rounded once.
    centred = [[n * p - a * b for p, b in zip(row, sums, strict=True)] for row, a in zip(stats.products, sums, strict=True)]
    covariance = np.array([[x / (n * n) for x in row] for row in centred])
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > len(sums) * np.finfo(float).eps * max(values[-1], 0.0)]
    trace = sum(centred[i][i] for i in range(len(sums))) / (n * n)
    return Basis(n, sums, axes[:, order] / np.sqrt(values[order]), (values[order] / trace).tolist())


def centred_rows(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * value - sum, exact: int64 if all fit, else Python integers."""
    most = n * int(np.abs(values).max(initial=0)) + max(map(abs, sums))
    if most < 1 << 62:
        return values * n - np.array(sums, np.int64)
    return values.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> pa.Array:
    """Sum of the squares of every row; null beyond 38 digits."""
    fits = centred.dtype != object and centred.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 63
    wide = centred if fits else centred.astype(object)
    totals = (wide * wide).sum(axis=1)
    return pa.array([Decimal(int(t)) if t < 10**38 else None for t in totals], _WHOLE)


def _whitened(centred: np.ndarray, turn: Basis) -> np.ndarray:
    exact = centred if centred.dtype != object else (centred / turn.n).astype(float) * turn.n
    return (exact.astype(float) / turn.n) @ turn.axes


def identity_error(df: DataFrame, turn: Basis, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    size = turn.axes.shape[1]
    if not size:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                rows = _whitened(centred_rows(floored(batch.column(0), scale), turn.n, turn.sums), turn)
                rows = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
                total += rows.T @ rows
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    parts = usable_rows(df, vec_id, vector).select("vec").mapInArrow(run, "i int, j int, v double")
    total = np.zeros((size + 1, size + 1))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[row.i, row.j] = row.v
    # The rows are centred already, so taking their mean off again loses nothing.
    mean = total[size, :size] / turn.n
    return float(np.abs(total[:size, :size] / turn.n - np.outer(mean, mean) - np.eye(size)).max())


def whiten(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) for each usable vector; repeated rows count as often as they occur.

    Vectors that are null or empty, or hold a null, NaN or infinite entry, are
    left out; a null id stays. Entries become x = floor(scale * entry); any
    constant added to them changes nothing here. `whitened` has a value for
    each component of falling eigenvalue, `explained` each component's share of
    the variance; directions without variance are not components, so an empty
    table gives no row and a single vector gives empty arrays. `deviation` is
    the sum of (n*x - S)^2 as a whole decimal, null beyond 38 digits. Vectors of
    several lengths and entries beyond 64-bit integers end in a ValueError.
    The statistics are taken in one pass over `df`, `identity_error` in another.
    """
    turn = basis(scatter(df, vec_id, vector, scale), components)
    error = identity_error(df, turn, vec_id, vector, scale)
    rows = usable_rows(df, vec_id, vector)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                centred = centred_rows(floored(batch.column(1), scale), turn.n, turn.sums)
                flat = _whitened(centred, turn)
                ends = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
                values = pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), _deviations(centred), values], ["id", "deviation", "whitened"])

    projected = rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    return projected.select(
        F.col("id").alias(vec_id),
        F.lit(turn.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.lit(turn.explained).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
