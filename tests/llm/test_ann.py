"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score int"
ASKS = "vec_id % 50 = 0"


def brute(ids, vectors, k=5):
    vectors = vectors.astype(np.float64)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    out = {}
    for a in np.flatnonzero(ids % 50 == 0):
        scores = vectors @ vectors[a] / lengths / lengths[a]
        others = np.flatnonzero(np.arange(len(ids)) != a)
        order = others[np.lexsort((ids[others], -np.round(scores[others], 12)))][:k]
        out[int(ids[a])] = [(int(ids[x]), scores[x]) for x in order]
    return out


def found(df, **options):
    out = {}
    for r in ann.nearest(df, F.expr(ASKS), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = df.toArrow()
    want = brute(table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()))
    got = found(df)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 5 * len(want)
    exact = {q: dict(want[q]) for q in want}
    for q in want:
        for i, score in got[q]:
            if i in exact[q]:
                assert score == pytest.approx(exact[q][i], abs=1e-12)


def test_clusters_and_full_cells(spark, monkeypatch):
    """Clustered vectors need few cells; blocks smaller than a cell split it."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(0, 20, 1500)] + 0.1 * rng.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], SCHEMA)
    monkeypatch.setattr(ann, "BLOCK", 16)
    got, want = found(df), brute(np.arange(1500), vectors)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_odd_vectors_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (50, [1.0, 0.0]), (9, [-1.0, 0.0]), *odd]
    rows += [(100 + k, [1.0, 0.0]) for k in range(20)]  # a vector that most rows share
    got = found(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA))
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {
        0: [1, 50, 100, 101, 102], 50: [0, 1, 100, 101, 102], 100: [0, 1, 50, 101, 102],
    }


def test_few_and_no_vectors(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)) == {}
    got = found(spark.createDataFrame([(0, [1.0], 1), (1, [3.0], 1), (2, [-1.0], 1)], SCHEMA))
    assert got == {0: [(1, 1.0), (2, -1.0)]}


def test_cells_come_in_order_of_distance():
    rng = np.random.default_rng(6)
    left, right = rng.normal(size=(7, 3)), rng.normal(size=(5, 3))
    index = ann.Index(left, right, rng.integers(0, 4, (7, 5)))
    point = rng.normal(size=6)
    total = ann.distances(point[None, :3], left)[0][:, None] + ann.distances(point[None, 3:], right)[0][None]
    order = [c for c in np.argsort(total.ravel(), kind="stable").tolist() if index.counts.ravel()[c]]
    assert ann.visited(index, point, 10**9) == order
    few = ann.visited(index, point, 6)
    assert few == order[: len(few)] and index.counts.ravel()[few].sum() >= 6
