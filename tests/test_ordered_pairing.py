"""Ordered pairing against a plain fold, with hot keys spread over partitions."""

import random

import pytest
from pyspark.sql import functions as F

from orderloom.operators.ordered_pairing import settle


@pytest.fixture(autouse=True)
def small_partitions(spark):
    """Keeps all shuffle partitions, so that the rows really are spread."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fold(rows):
    """Brute force: one pass over rows in order, one open row per key."""
    opened, pairs = {}, []
    for key, seq, left in sorted(rows):
        if key not in opened:
            opened[key] = (seq, left)
        elif opened[key][1] != left:
            other = opened.pop(key)[0]
            pairs.append((key, seq, other) if left else (key, other, seq))
    pending = [(k, s, None) if left else (k, None, s) for k, (s, left) in opened.items()]
    return sorted(pairs), sorted(pending, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "k string, seq bigint, is_left boolean").repartition(4)
    settled = settle(df, F.col("k"), [F.col("seq")], F.col("is_left"), F.col("seq"))
    pairs = sorted((r.key, r.left, r.right) for r in settled.pairs().collect())
    pending = [(r.key, r.left, r.right) for r in settled.open_rows().collect()]
    return pairs, sorted(pending, key=str)


def sides(letters):
    return [("k", i, c == "L") for i, c in enumerate(letters, 1)]


def test_demo_input(spark):
    rows = [("1", 1, False), ("3", 2, False), ("2", 3, True), ("2", 4, False), ("3", 5, True),
            ("1", 6, True)]
    assert run(spark, rows) == ([("1", 6, 1), ("2", 3, 4), ("3", 5, 2)], [])


@pytest.mark.parametrize(
    "letters, pairs, pending",
    [
        ("LLRRL", [("k", 1, 3), ("k", 5, 4)], []),
        ("LL", [], [("k", 1, None)]),
        ("LRR", [("k", 1, 2)], [("k", None, 3)]),
        ("R", [], [("k", None, 1)]),
    ],
)
def test_repeated_sides(spark, letters, pairs, pending):
    assert run(spark, sides(letters)) == (pairs, pending)


def test_empty(spark):
    assert run(spark, [r for r in sides("L") if r[1] > 1] or []) == ([], [])


@pytest.mark.parametrize("seed", range(4))
def test_hot_key_over_many_partitions(spark, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(200)}"
        left = rng.random() < (0.5, 0.9, 0.1, 0.5)[seed]
        rows.append((key, seq, left))
    assert run(spark, rows) == fold(rows)


def test_alternating_hot_key_small_batches(spark):
    """Strict alternation never resets, so the start of each partition decides its pairs."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a", i, i % 2 == 0) for i in range(1001)]
        assert run(spark, rows) == fold(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_struct_values(spark):
    rows = [("a", 1, True), ("a", 2, False), ("b", 3, False)]
    df = spark.createDataFrame(rows, "k string, seq bigint, is_left boolean")
    settled = settle(df, F.col("k"), [F.col("seq")], F.col("is_left"), F.struct("seq", "k"))
    assert [(r.left.seq, r.right.k) for r in settled.pairs().collect()] == [(1, "a")]
    assert [(r.left, r.right.seq) for r in settled.open_rows().collect()] == [(None, 3)]


def test_merged_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = [("a" if i % 3 else "b", i, i % 2 == 0) for i in range(500)]
    assert run(spark, rows) == fold(rows)
