"""Whitening of embeddings, with covariances found by polarisation.

An entry c counts as the integer x = floor(64 c) + 1,000,000. One pass adds up every dimension, which
gives an integer centre next to each mean. A second pass adds up the squares of the centred values y of
each dimension and of each sum of two dimensions, y_i + y_j, as exact integers: a task sends one number
for each dimension and pair, and Spark adds these up by pair. The cross-covariances follow as half of
Var(x_i + x_j) - Var(x_i) - Var(x_j), still in integers (what the means are off their centres is taken
out exactly), and are rounded once, when the matrix is assembled for ``eigh``. As the centre is near the
mean at every size of the table, nothing cancels, and the sums of a batch fit 64 bits; values for which
they would not are added up as unbounded integers.

The driver holds one number for each pair of dimensions, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
LIMIT = 2.0**34  # entries of this size and more have no place in whole numbers that squares can carry
ROWS = 2048  # rows added up at a time, so that they stay in the processor's cache
LONG = 2**63

_EXACT = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """Not null nor empty, and every entry a finite number below the limit."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LIMIT)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def integers(column: pa.Array, size: int) -> np.ndarray:
    """The integers x of vectors of one size, a row for each vector."""
    values = np.asarray(column.flatten(), np.float64).reshape(-1, size)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def _exact(numbers) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in numbers], _EXACT)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, dimension, n, total) of a task's vectors, for each size they have."""
    totals: dict[int, list] = {}
    for batch in batches:
        column = batch.column(0)
        lengths = np.asarray(column.value_lengths())
        for size in np.unique(lengths).tolist():
            rows = integers(column.filter(pa.array(lengths == size)), size)
            held = totals.setdefault(size, [0, np.zeros(size, object)])
            held[0] += len(rows)
            for low in range(0, len(rows), ROWS):
                held[1] += rows[low : low + ROWS].sum(axis=0).astype(object)
    for size, (n, total) in totals.items():
        columns = [np.full(size, size), np.arange(size), np.full(size, n)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _exact(total)], ["size", "dim", "n", "total"])


class Centre(NamedTuple):
    n: int
    size: int
    centre: np.ndarray  # integers next to the means
    rest: list[int]  # sums of the centred values

    def centred(self, column: pa.Array) -> np.ndarray:
        return integers(column, self.size) - self.centre


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums over the rows of (y_i + y_j)^2 for i < j, behind the sums of y_i^2; exact."""
    size = y.shape[1]
    bound = 4 * int(max(abs(int(y.max())), abs(int(y.min())))) ** 2 if len(y) else 0
    columns = np.ascontiguousarray(y.T if bound * len(y) < LONG else y.T.astype(object))
    parts = [(columns * columns).sum(axis=1)]
    for i in range(size - 1):
        both = columns[i + 1 :] + columns[i]
        parts.append((both * both).sum(axis=1))
    return np.concatenate(parts).astype(object)


def places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions (i, j) that each number of ``pair_squares`` is for; i = j for the squares."""
    i, j = np.triu_indices(size, 1)
    return np.concatenate([np.arange(size), i]), np.concatenate([np.arange(size), j])


def _square_sums(centre: Centre):
    def square_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            y = centre.centred(batch.column(0))
            for low in range(0, len(y), ROWS):
                total = total + pair_squares(y[low : low + ROWS])
        if isinstance(total, np.ndarray):
            i, j = places(centre.size)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), _exact(total)], ["i", "j", "squares"])

    return square_sums


def covariance(centre: Centre, squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance matrix by polarisation; each entry is the exact value, rounded once."""
    n, rest = centre.n, centre.rest
    spread = [n * squares[i, i] - rest[i] ** 2 for i in range(centre.size)]  # n^2 times the variances
    matrix = np.empty((centre.size, centre.size))
    for (i, j), total in squares.items():
        if i == j:
            matrix[i, i] = spread[i] / n**2
        else:
            both = n * total - (rest[i] + rest[j]) ** 2
            matrix[i, j] = matrix[j, i] = (both - spread[i] - spread[j]) / (2 * n**2)
    return matrix


class Components(NamedTuple):
    vectors: np.ndarray  # unit eigenvectors as columns, by falling eigenvalue
    values: np.ndarray
    explained: np.ndarray
    sound: np.ndarray  # the eigenvalue is more than rounding


def decompose(matrix: np.ndarray, count: int) -> Components:
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    sound = values > max(values[0], 0.0) * len(values) * np.finfo(float).eps
    trace = np.trace(matrix)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    return Components(vectors[:, :count], values[:count], explained[:count], sound[:count])


def whiten(y: np.ndarray, centre: Centre, parts: Components) -> np.ndarray:
    """Projections over the root of the eigenvalue; NaN where that is zero.

    Dimensions are added in their order for every row alike, so a row's result does not depend on the
    rows beside it.
    """
    off = np.array([s / centre.n for s in centre.rest])
    root = np.sqrt(np.where(parts.sound, parts.values, np.nan))
    out = np.zeros((len(y), len(root)))
    for k in range(centre.size):
        out += (y[:, k] - off[k])[:, None] * parts.vectors[k]
    return out / root


def deviations(y: np.ndarray, centre: Centre) -> pa.Array:
    """Sums over the dimensions of (n x - S)^2, exact; null where a long cannot hold one."""
    n, rest = centre.n, np.array(centre.rest, object)
    bound = max(map(abs, centre.rest)) + n * (int(np.abs(y).max()) if y.size else 0)
    if bound**2 * centre.size < LONG:
        z = n * y - rest.astype(np.int64)
        return pa.array((z * z).sum(axis=1))
    z = n * y.astype(object) - rest
    return pa.array([x if x < LONG else None for x in (z * z).sum(axis=1)], pa.int64())


_MOMENT = "i int, j int, total double"


def _moments(centre: Centre, parts: Components):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the whitened values (j = -1) and of their products."""
        k = int(parts.sound.sum())
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = centre.centred(batch.column(0))
            for low in range(0, len(y), ROWS):
                w = whiten(y[low : low + ROWS], centre, parts)[:, :k]
                first += w.sum(axis=0)
                second += w.T @ w
        i, j = np.meshgrid(np.arange(k), np.arange(-1, k), indexing="ij")
        total = np.concatenate([first[:, None], second], axis=1)
        columns = [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    return moments


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _rows(centre: Centre, parts: Components, error: float | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(parts.values)
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                some = batch.slice(low, ROWS)
                y = centre.centred(some.column(1))
                at = pa.array(np.repeat(np.arange(len(y)), k))
                white = whiten(y, centre, parts).ravel()
                columns = [
                    some.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(at), centre.n)),
                    deviations(y, centre).take(at),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(parts.explained, len(y))),
                    pa.array([error] * len(at), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _OUT.split(", ")])

    return rows


def whitened(
    vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding", components: int = 32
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each vector and component.

    Components are numbered from 1 by falling eigenvalue, ``components`` at most; the entry of largest
    size of each eigenvector is positive. ``explained`` is the eigenvalue's share of the total variance
    (0 if there is none), ``identity_error`` the largest entry of the whitened values' covariance minus
    the identity, measured over all rows (null if no component has a variance).

    Vectors that are null or empty, hold null or non-finite entries or entries of 2^34 and more, or are
    of another length than most (on a tie the longest) take no part. Rows without id, repeated rows and
    equal vectors all count. A component without variance, which has no whitened value, has null there;
    so has every one of a single row or of equal rows. ``deviation`` is null where a long cannot hold
    it. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.transform(F.col(embedding), lambda x: x.cast("double")).alias("vector"),
    ).filter(usable(F.col("vector")))
    sums = rows.select("vector").mapInArrow(add_up, "size bigint, dim bigint, n bigint, total decimal(38,0)")
    sums = sums.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by_size = sums.groupBy("size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "total"))).alias("totals"))
    most = by_size.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], _OUT)
    n, size, totals = most["n"], most["size"], [int(r["total"]) for r in most["totals"]]
    means = [(2 * s + n) // (2 * n) for s in totals]
    centre = Centre(n, size, np.array(means, np.int64), [s - n * m for s, m in zip(totals, means)])
    rows = rows.filter(F.size("vector") == size)

    squares = rows.select("vector").mapInArrow(_square_sums(centre), "i bigint, j bigint, squares decimal(38,0)")
    total = squares.groupBy("i", "j").agg(F.sum("squares").alias("squares")).collect()
    parts = decompose(covariance(centre, {(r["i"], r["j"]): int(r["squares"]) for r in total}), components)

    error = None
    if parts.sound.any():
        moments = rows.select("vector").mapInArrow(_moments(centre, parts), _MOMENT)
        found = {(r["i"], r["j"]): r["total"] / n for r in moments.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
        error = max(abs(v - found[i, -1] * found[j, -1] - (i == j)) for (i, j), v in found.items() if j >= 0)
    return rows.mapInArrow(_rows(centre, parts, error), _OUT)
