"""Timers across batches, and snapshots by the clock."""

import random
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.counters import api_counters
from orderloom.streaming import timers as module
from orderloom.streaming.snapshots import given_clock, run_snapshots, seconds, snapshots
from orderloom.streaming.timers import Timers

ROW = "id string, start_ms bigint, stop_ms bigint"


def started(key, at):
    return (key, at, None)


def stopped(key, at):
    return (key, None, at)


def handled(spark, root, *batches):
    timers = Timers(spark, root, T.StringType())
    for n, rows in enumerate(batches):
        assert timers.handle(spark.createDataFrame(rows, ROW), "r", n)
    return timers


def totals(timers):
    return tuple(timers.counters().select("IN", "OK", "ELAPSED").first())


def open_ids(timers):
    return {tuple(r) for r in timers.open_timers().collect()}


def test_start_and_stop_in_batches_of_their_own(spark, tmp_path):
    timers = handled(
        spark,
        str(tmp_path),
        [started("a", 10), started("b", 20), stopped("early", 5)],
        [stopped("a", 25), stopped("nobody", 7)],
        [started("early", 2), started("c", 30), stopped("c", 31)],
    )
    assert totals(timers) == (4, 4, 15 + 3 + 1)
    assert open_ids(timers) == {("b", 20, None), ("nobody", None, 7)}
    assert [tuple(r) for r in timers.in_flight().collect()] == [("b", 20)]


def test_a_batch_counts_once(spark, tmp_path):
    timers = handled(spark, str(tmp_path), [started("a", 10)], [stopped("a", 12)])
    assert not timers.handle(spark.createDataFrame([stopped("a", 12)], ROW), "r", 1)
    assert totals(timers) == (1, 1, 2)


def test_repeats_nulls_and_empty_batches(spark, tmp_path):
    timers = handled(
        spark,
        str(tmp_path),
        [],
        [started("a", 10), started("a", 10), (None, 1, None), ("b", None, None)],
        [started("a", 9)],
        [stopped("a", 13), stopped("a", 12)],
        [started("a", 20)],
    )
    assert totals(timers) == (2, 1, 2)
    assert open_ids(timers) == {("a", 20, None)}


def test_any_split_into_batches_gives_the_batch_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "COMPACT_EVERY", 2)
    rng = random.Random(5)
    starts = {f"t{k}": rng.randrange(1000) for k in range(60)}
    stops = {f"t{k}": rng.randrange(1000) for k in range(20, 80)}
    arriving = [started(*i) for i in starts.items()] + [stopped(*i) for i in stops.items()]
    rng.shuffle(arriving)
    timers = handled(spark, str(tmp_path), *(arriving[n::5] for n in range(5)))
    expected = api_counters(
        spark.createDataFrame(list(starts.items()), "id string, start_ms bigint"),
        spark.createDataFrame(list(stops.items()), "id string, stop_ms bigint"),
    )
    assert timers.counters().first() == expected.first()
    assert {r["id"] for r in timers.in_flight().collect()} == {f"t{k}" for k in range(20)}


def test_no_timers(spark, tmp_path):
    timers = Timers(spark, str(tmp_path), T.StringType())
    assert totals(timers) == (0, 0, 0)
    assert open_ids(timers) == set()


def test_snapshots_of_an_idle_store(spark, tmp_path):
    timers, root = handled(spark, f"{tmp_path}/t", [started("a", 10)]), f"{tmp_path}/s"
    for n in range(3):
        if n == 2:
            timers.handle(spark.createDataFrame([stopped("a", 14)], ROW), "r", 1)
        ticks = given_clock(spark, 1_000_000, 5_000)
        run_snapshots(ticks, timers.counters, root, f"{tmp_path}/c", {"availableNow": True}).awaitTermination()
    found = snapshots(spark, root).filter(F.col("name").endswith(".COMPLETE"))
    assert sorted((r["epoch_ms"], r["value"]) for r in found.collect()) == [
        (1_000_000, "0"), (1_005_000, "0"), (1_010_000, "1"),
    ]


def test_the_clock_of_the_machine_makes_snapshots(spark, tmp_path):
    timers, root = Timers(spark, f"{tmp_path}/t", T.StringType()), f"{tmp_path}/s"
    query = run_snapshots(seconds(spark), timers.counters, root, f"{tmp_path}/c", {"processingTime": "1 second"})
    until = time.time() + 60
    while snapshots(spark, root).select("epoch_ms").distinct().count() < 2 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    times = sorted(r[0] for r in snapshots(spark, root).select("epoch_ms").distinct().collect())
    assert len(times) >= 2 and times[0] > 1_600_000_000_000
