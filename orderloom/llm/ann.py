"""Approximate nearest neighbours by cosine, with an inverted multi-index.

The two halves of each unit vector are quantised apart, so K centroids for each half give K * K cells.
A query visits cells in the order of the summed distances of its halves to their centroids, taken
from a heap, until the cells hold enough vectors. Those are reranked by the exact cosine. How many are
enough is measured: on a bounded sample, true neighbours show what share of the vectors has to be seen
for the recall wanted. Vectors without structure need a large share, clustered ones a small one.

Cells are dealt out in groups of some ``BLOCK`` vectors, a cell that is fuller in several. A query goes
once to each group it has cells in, with the list of those cells.

Equal vectors stand in the index once, with as many of their smallest ids as an answer can need, so a
vector that a third of the rows share is one entry. The driver holds a bounded sample while it fits
the centroids, and one count for each cell; every vector is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import mix, stored

BLOCK = 4096


class Index(NamedTuple):
    left: np.ndarray  # centroids of first halves
    right: np.ndarray
    counts: np.ndarray  # vectors in each cell, by left and right centroid


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, size)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (point, centroid)."""
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)[None]


def k_means(points: np.ndarray, k: int, rounds: int = 15, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))]
    for _ in range(rounds):
        nearest = distances(points, centroids).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def cells(vectors: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    half = vectors.shape[1] // 2
    points = unit(vectors)
    return distances(points[:, :half], left).argmin(axis=1) * len(right) + distances(points[:, half:], right).argmin(axis=1)


def visited(index: Index, point: np.ndarray, candidates: int) -> list[int]:
    """Cells in the order of summed distance until they hold enough vectors; empty ones are left out."""
    half = len(point) // 2
    first, second = distances(point[None, :half], index.left)[0], distances(point[None, half:], index.right)[0]
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    first, second = first[rows], second[columns]
    heap = [(first[0] + second[0], 0, 0)]
    found, total = [], 0
    while heap and total < candidates:
        _, i, j = heapq.heappop(heap)
        n = int(index.counts[rows[i], columns[j]])
        if n:
            found.append(int(rows[i]) * len(columns) + int(columns[j]))
            total += n
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))
        if j + 1 < len(columns):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
    return found


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def share_needed(points: np.ndarray, left: np.ndarray, right: np.ndarray, recall: float, k: int, queries: int = 300) -> float:
    """Share of the vectors in the cells to visit so that this part of the k nearest is among them."""
    if len(points) <= k + 1:
        return 1.0
    half = points.shape[1] // 2
    cell = cells(points, left, right)
    counts = np.bincount(cell, minlength=len(left) * len(right))
    shares = []
    for row in range(min(queries, len(points))):
        likeness = points @ points[row]
        likeness[row] = -2
        true = np.argpartition(-likeness, k)[:k]
        point = points[row : row + 1]
        total = distances(point[:, :half], left)[0][:, None] + distances(point[:, half:], right)[0][None]
        order = np.argsort(total.ravel(), kind="stable")
        seen = np.empty(len(order))
        seen[order] = np.cumsum(counts[order])
        shares += (seen[cell[true]] / len(points)).tolist()
    return float(np.quantile(shares, recall))


def groups_of(cell: np.ndarray, part: np.ndarray, groups: int) -> np.ndarray:
    """Group of each part of a cell."""
    return (mix(cell.astype(np.uint64) << np.uint64(20) | part.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(size: int, k: int):
    def search(entries: pa.Table, queries: pa.Table) -> pa.Table:
        """The best k rows of a group's visited cells for each query that comes here."""
        if not len(entries) or not len(queries):
            return _HIT.empty_table()
        entries, queries = entries.sort_by("cell").combine_chunks(), queries.combine_chunks()
        vectors, points = (_rows(t["vector"].combine_chunks(), size) for t in (entries, queries))
        vectors, points = (x / np.abs(x).max(axis=1, keepdims=True) for x in (vectors, points))
        lengths, own = (np.sqrt((x * x).sum(axis=1)) for x in (vectors, points))
        ids, cell = entries["ids"].to_pylist(), entries["cell"].to_numpy()
        asked = queries["cells"].combine_chunks()
        offsets, wanted = np.asarray(asked.offsets), np.asarray(asked.values)
        out: list[tuple[int, int, float]] = []
        for row, query in enumerate(queries["query_id"].to_pylist()):
            mine = np.unique(wanted[offsets[row] : offsets[row + 1]])
            low, high = np.searchsorted(cell, mine), np.searchsorted(cell, mine, side="right")
            n = high - low
            seen = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            if not len(seen):
                continue
            rough = (vectors[seen] @ points[row]) / lengths[seen]
            # The k + 1 best vectors and all that rounding may have put behind them.
            best = np.partition(rough, -min(len(seen), k + 1))[-min(len(seen), k + 1)]
            near = seen[rough >= best - 1e-12 * own[row]]
            exact = (vectors[near] * points[row]).sum(axis=1) / (lengths[near] * own[row])
            hits = sorted((-s, i) for v, s in zip(near, exact.tolist()) for i in ids[v] if i != query)
            out += [(query, i, -s) for s, i in hits[:k]]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _HIT)], schema=_HIT) if out else _HIT.empty_table()

    return search


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    embedding: str = "embedding",
    sample_rows: int = 20_000,
    recall: float = 0.97,
    per_cell: int = 8,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest rows, nearest first.

    Queries are the rows for which ``is_query`` holds, by the columns of ``vectors``; a query's own id
    is no candidate. Equal scores are ordered by id. Null and zero vectors, vectors with null or
    non-finite components, rows without id, and vectors of another length than most (on a tie the
    longest) take no part. Equal rows count once; an id with several vectors is a candidate with each
    and asks with the smallest. Fewer candidates than k are all returned; an empty table gives no
    rows. Other columns are ignored.

    The centroids and the share of vectors to see for the ``recall`` are fitted on at most
    ``sample_rows`` distinct vectors, with about ``per_cell`` vectors a cell (256 centroids a half at most).
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.transform(F.col(embedding), lambda x: x.cast("double")).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 1
    rows = rows.filter(F.size("vector") == size)

    # The smallest k + 1 ids of each distinct vector; the limit applies before the exchange, too.
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("vector").orderBy("id")))
    distinct = ranked.filter(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    entries = stored(distinct, "vectors")
    n = entries.count()
    sample = entries.orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).select("vector").toArrow()["vector"].combine_chunks()
    points = unit(_rows(sample, size)) if len(sample) else np.ones((1, size))
    per_side = int(np.clip(np.sqrt(n / per_cell), 1, 256))
    half = size // 2
    left, right = k_means(points[:, :half], per_side), k_means(points[:, half:], per_side)
    candidates = int(np.ceil(share_needed(points, left, right, recall, k) * n))
    groups = max(1, -(-n // BLOCK))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells(_rows(batch.column(0), size), left, right) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns], ["cell", "vector", "ids"])

    located = stored(entries.select("vector", "ids").mapInArrow(locate, "cell bigint, vector array<double>, ids array<bigint>"), "cells")
    counts = np.zeros(len(left) * len(right), np.int64)
    for row in located.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    shared = spark.sparkContext.broadcast(Index(left, right, counts.reshape(len(left), len(right))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            parts = np.maximum(-(-shared.value.counts.ravel()[cell] // BLOCK), 1)
            part = batch.column(3).to_numpy().view(np.uint64) % parts.astype(np.uint64)
            group = pa.array(groups_of(cell, part, groups))
            yield pa.RecordBatch.from_arrays([group, *batch.columns[:3]], ["group", "cell", "vector", "ids"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value.counts.ravel()
        for batch in batches:
            points = unit(_rows(batch.column(1), size)) if len(batch) else np.zeros((0, size))
            for row, point in enumerate(points):
                cell = np.array(visited(shared.value, point, candidates), np.int64)
                parts = -(-counts[cell] // BLOCK)
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                cell = np.repeat(cell, parts)
                group = groups_of(cell, part, groups)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(order)), pa.int32()), pa.array(cell[order]))
                one = batch.take(pa.array(np.full(len(cuts), row), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(group[order][cuts]), *one.columns, lists], ["group", "query_id", "vector", "cells"])

    asking = rows.filter("asks").groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector"))
    # Few queries, but much work each, so they must not be put together in few tasks.
    asking = asking.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    asked = asking.mapInArrow(visit, "group bigint, query_id bigint, vector array<double>, cells array<bigint>")
    dealt = located.select("cell", "vector", "ids", F.xxhash64("vector")).mapInArrow(
        deal, "group bigint, cell bigint, vector array<double>, ids array<bigint>"
    )
    hits = (
        dealt.groupBy("group")
        .cogroup(asked.groupBy("group"))
        .applyInArrow(_search(size, k), "query_id bigint, vec_id bigint, score double")
    )
    # An id with several vectors may come up twice; its best score counts.
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
