"""Streams against the batch operators, with retries, repeats and keys across batches."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import gappy_lookups
from orderloom.operators.counters import stage_metrics
from orderloom.operators.events import create_order_responses
from orderloom.operators.view import view_rejects
from orderloom.plans.lifecycle import all_events, all_rejects, current_view, order_facts
from orderloom.schemas import CREATE, EVENT_COLUMNS, REQUEST, RESERVE
from orderloom.sinks import batches
from orderloom.sinks.tables import EVENTS, append_events, drop_events_up_to
from orderloom.sources import tables
from orderloom.sources.event_store import follow, read_events
from orderloom.sources.requests import stream_requests
from orderloom.streaming import orders, pairing, view
from test_ordered_pairing import fold

NOW = {"availableNow": True}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def requests(spark, small):
    return tables.requests(spark, small).limit(400).cache()


@pytest.fixture(scope="module")
def lookups(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookups"))
    return tables.saved_lookups(gappy_lookups(spark, small), path)


def run(spark, arriving, root, lookups, checkpoint, **options):
    stream = stream_requests(spark, arriving)
    orders.run_orders(stream, root, lambda: lookups, checkpoint, NOW, **options).awaitTermination()


def test_stream_equals_batch_and_drops_repeats(spark, requests, lookups, tmp_path):
    arriving, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    first = requests.filter(F.crc32("request_id") % 2 == 0)
    first.write.parquet(arriving)
    run(spark, arriving, root, lookups, checkpoint, clock=lambda: 2_000_000_000_000)
    # The second batch brings the rest, everything again, one request twice and one without id.
    odd = requests.limit(1).withColumn("request_id", F.lit(None).cast("string"))
    again = requests.union(requests.limit(1)).union(odd)
    again.coalesce(1).write.mode("append").parquet(arriving)
    run(spark, arriving, root, lookups, checkpoint, clock=lambda: 2_000_000_001_000)
    facts = order_facts(requests.union(odd), lookups)
    stored = read_events(spark, root)
    assert rows(stored, *EVENT_COLUMNS) == rows(all_events(facts), *EVENT_COLUMNS)
    assert rows(orders.rejects(spark, root)) == rows(all_rejects(facts))
    assert stored.select("attempt").distinct().count() == 2
    counted = orders.counters(spark, root).first()
    n_first = first.count()
    assert (counted.IN, counted.OK, counted.COMPLETE) == (n_first + 402, 400, 400)
    arrived = requests.agg(F.sum("arrived_ms")).first()[0]
    assert counted.ELAPSED == 400 * 2_000_000_000_000 + (400 - n_first) * 1000 - arrived
    assert rows(orders.responses(spark, root)) == rows(create_order_responses(requests))
    assert rows(orders.job_metrics(spark, root), "metric", "n") == rows(stage_metrics(stored), "metric", "n")
    # Each batch adds a snapshot of the counters at its own time.
    series = orders.metric_series(spark, root)
    ins = series.filter("name = 'order.create.IN'").select("epoch_ms", "value")
    assert rows(ins) == [(2_000_000_000_000, str(n_first)), (2_000_000_001_000, str(n_first + 402))]
    # Neither compaction nor retention of events changes totals, or lets a repeat in.
    orders.compact_orders(spark, root)
    drop_events_up_to(spark, root, 2)
    requests.limit(7).coalesce(1).write.mode("append").parquet(arriving)
    run(spark, arriving, root, lookups, checkpoint, clock=lambda: 2_000_000_002_000)
    assert orders.counters(spark, root).first().IN == n_first + 409
    assert orders.counters(spark, root).first().OK == 400
    assert read_events(spark, root).count() == 0


def test_a_lost_checkpoint_deletes_nothing(spark, requests, lookups, tmp_path):
    arriving, root = str(tmp_path / "in"), str(tmp_path / "out")
    requests.limit(60).write.parquet(arriving)
    for checkpoint in ("c1", "c2"):
        run(spark, arriving, root, lookups, str(tmp_path / checkpoint))
        stored = read_events(spark, root)
        assert rows(stored, *EVENT_COLUMNS) == rows(
            all_events(order_facts(requests.limit(60), lookups)), *EVENT_COLUMNS
        )


def test_retried_batch_changes_nothing(spark, requests, lookups, tmp_path):
    root = str(tmp_path)
    half = requests.filter(F.crc32("request_id") % 2 == 0)
    orders.process_batch(half, root, "r", 0, lookups)
    orders.process_batch(requests, root, "r", 1, lookups)
    once = rows(read_events(spark, root), *EVENT_COLUMNS, "attempt")
    assert not orders.process_batch(requests, root, "r", 1, lookups)
    assert not orders.process_batch(half, root, "r", 0, lookups)
    assert rows(read_events(spark, root), *EVENT_COLUMNS, "attempt") == once


def test_restart_after_a_failed_batch(spark, requests, lookups, tmp_path, monkeypatch):
    """A batch that fails after its events are written is run again, and no reader sees the first."""
    arriving, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    requests.limit(60).write.parquet(arriving)
    seen = []

    def broken(*_):
        seen.append(read_events(spark, root).count())
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as patch:
        patch.setattr(batches.Batch, "commit", broken)
        with pytest.raises(Exception, match="lost before the commit"):
            run(spark, arriving, root, lookups, checkpoint)
    assert seen == [0] and read_events(spark, root).count() == 0
    run(spark, arriving, root, lookups, checkpoint)
    facts = order_facts(requests.limit(60), lookups)
    assert rows(read_events(spark, root), *EVENT_COLUMNS) == rows(all_events(facts), *EVENT_COLUMNS)
    assert orders.counters(spark, root).first().IN == 60


def test_deliveries_that_differ_or_lack_an_id(spark, lookups, tmp_path):
    """The first accepted request stands, in one batch or over several; others are rejects."""
    deliveries = [("r1", "b", "i", "l", 2, 10), ("r1", "a", "i", "l", 9, 20), ("r1", "b", "i", "l", 2, 30)]
    deliveries += [("r2", None, "i", "l", 1, None), (None, "a", "i", "l", 1, 5), (None, "a", "i", "l", 1, 5)]
    nothing = spark.createDataFrame([], REQUEST)
    for order in (deliveries, deliveries[::-1]):
        given = spark.createDataFrame(order, REQUEST).repartition(3)
        kept, rejected = orders.accept(given, nothing)
        assert rows(kept) == [
            ("r1", "b", "i", "l", 2, 10), ("r2", None, "i", "l", 1, None),
            (None, "a", "i", "l", 1, 5), (None, "a", "i", "l", 1, 5),
        ]
        assert rows(rejected) == [("r1", "CreateOrder", orders.DIFFERS)]
    # Over batches of one delivery each, in order of arrival, the result is the same.
    root = str(tmp_path)
    for batch, delivery in enumerate(deliveries[:3]):
        orders.process_batch(spark.createDataFrame([delivery], REQUEST), root, "r", batch, lookups)
    accepted = batches.read(spark, root, orders.ACCEPTED, REQUEST)
    assert rows(accepted) == [("r1", "b", "i", "l", 2, 10)]
    assert ("r1", "CreateOrder", orders.DIFFERS) in rows(orders.rejects(spark, root))


def test_batch_without_requests(spark, requests, lookups, tmp_path):
    root = str(tmp_path)
    orders.process_batch(requests.limit(0), root, "r", 0, lookups)
    orders.process_batch(requests.limit(5), root, "r", 1, lookups)
    assert read_events(spark, root).filter(F.col("event_name") == CREATE).count() == 5


def test_view_follows_the_log(spark, requests, lookups, tmp_path, monkeypatch):
    log, path, checkpoint = (str(tmp_path / n) for n in ("log", "view", "checkpoint"))
    monkeypatch.setattr(view, "COMPACT_EVERY", 2)
    kept = view.MaintainedView(spark, path)
    facts = order_facts(requests, lookups)
    events = all_events(facts)
    parts = events.filter("sequence = 1"), events.filter("sequence > 1")
    expected = current_view(facts)
    for batch, part in enumerate(parts):
        append_events(part, log, "a", batch)
        follow(spark, log, kept.handle, checkpoint, NOW).awaitTermination()
        if batch == 0:
            unpriced = expected.withColumn("unit_price", F.lit(None).cast("decimal(10,2)"))
            assert rows(kept.view()) == rows(unpriced)
    assert rows(kept.view()) == rows(expected)
    assert kept.rejects().count() == 0
    # An order that turns out to have been used before it was created leaves the view.
    stray = events.filter(F.col("event_name") == RESERVE).limit(1).withColumn("sequence", F.lit(0).cast("bigint"))
    append_events(stray, log, "a", 2)
    follow(spark, log, kept.handle, checkpoint, NOW).awaitTermination()
    assert rows(kept.rejects()) == rows(view_rejects(read_events(spark, log)))
    assert kept.rejects().count() == 1 and kept.view().count() == 399


def test_follow_sees_each_batch_once(spark, requests, lookups, tmp_path):
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "c"))
    events = all_events(order_facts(requests, lookups)).limit(50).cache()
    seen = []
    for batch in (0, 0, 1):
        append_events(events, log, "a", batch)
        query = follow(spark, log, lambda new, run, n: seen.append(new.count()), checkpoint, NOW, EVENTS)
        query.awaitTermination()
    assert sum(seen) == 100


def pair_up(spark, root, arrivals):
    kept = pairing.Pairing(spark, root, T.StringType(), T.LongType())
    for n, batch in enumerate(arrivals):
        data = spark.createDataFrame(batch, "k string, seq bigint, is_left boolean")
        new = pairing.pairing_rows(data, F.col("k"), [F.col("seq")], F.col("is_left"), F.col("seq"))
        assert kept.handle(new, "r", n)
        assert not kept.handle(new, "r", n)
    return kept


def test_a_pair_clears_its_key(spark, tmp_path):
    """Left 1, right 10, later right 11: one pair, and 11 waits."""
    kept = pair_up(spark, str(tmp_path), [[("a", 1, True), ("a", 10, False)], [("a", 11, False)]])
    assert rows(kept.pairs()) == [("a", 1, 10)]
    assert rows(kept.open_rows()) == [("a", False, 11)]


def test_rows_without_key_or_side_are_kept_apart(spark, tmp_path):
    arrivals = [[(None, 1, True), ("a", 2, None), ("a", 3, True)], [("a", 4, False), (None, 5, None)]]
    kept = pair_up(spark, str(tmp_path), arrivals)
    assert rows(kept.pairs()) == [("a", 3, 4)]
    assert kept.open_rows().count() == 0
    found = rows(kept.unusable(), "value", "reason")
    assert found == [(1, "no key"), (2, "no side"), (5, "no key")]


def test_repeated_keys_across_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairing, "COMPACT_EVERY", 2)
    rng = random.Random(7)
    arrivals = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", seq, rng.random() < 0.5)
        for seq in range(600)
    ]
    kept = pair_up(spark, str(tmp_path), [arrivals[start : start + 200] for start in range(0, 600, 200)])
    pairs, pending = fold(arrivals)
    assert rows(kept.pairs()) == sorted(pairs, key=repr)
    waiting = sorted(((k, a or b) for k, a, b in pending), key=repr)
    assert rows(kept.open_rows(), "key", "value") == waiting


def test_time_bounded_pairs_give_up(spark, tmp_path):
    """A row without partner in time leaves the state as a pending row."""
    schema = "k string, at timestamp, v int"
    left_in, right_in = str(tmp_path / "l"), str(tmp_path / "r")

    def arrive(path, *arriving):
        data = [(k, v, at) for k, v, at in arriving]
        df = spark.createDataFrame(data, "k string, v int, at string")
        df.select("k", F.to_timestamp("at").alias("at"), "v").coalesce(1).write.mode("append").parquet(path)

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def step():
        left = spark.readStream.schema(schema).parquet(left_in)
        right = spark.readStream.schema(schema).parquet(right_in)
        pairs = pairing.pair_streams(left, right, "k", "at", "10 minutes", "full_outer")
        query = (
            pairs.writeStream.foreachBatch(lambda b, n: batches.append(b, out, "pairs", "r", n) and None)
            .option("checkpointLocation", checkpoint).trigger(**NOW).start()
        )
        query.awaitTermination()

    arrive(left_in, ("a", 1, "2024-01-01 00:00:00"), ("alone", 2, "2024-01-01 00:00:00"))
    arrive(right_in, ("a", 3, "2024-01-01 00:05:00"))
    step()
    for hour in ("2024-01-01 03:00:00", "2024-01-01 06:00:00"):
        arrive(left_in, ("late", 4, hour))
        arrive(right_in, ("late", 5, hour))
        step()
    side = "struct<at:timestamp,v:int>"
    pairs = batches.read(spark, out, "pairs", T.StructType.fromDDL(f"k string, left {side}, right {side}"))
    found = {(r.k, r.left and r.left.v, r.right and r.right.v) for r in pairs.collect()}
    assert {("a", 1, 3), ("alone", 2, None), ("late", 4, 5)} <= found


def test_elapsed_time_may_outgrow_a_long(spark, requests, lookups, tmp_path):
    """Arrivals far in the past, as those of tens of millions of orders add up to; each batch alone and both."""
    root = str(tmp_path / "out")
    for batch, some in enumerate([requests.limit(3), requests.subtract(requests.limit(3)).limit(2)]):
        old = some.withColumn("arrived_ms", F.lit(-(2**62)).cast("bigint"))
        assert orders.process_batch(old, root, "run", batch, lookups, clock=lambda: 10)
        counted = orders.counters(spark, root).first()
        n = (3, 5)[batch]
        assert (counted.OK, counted.ELAPSED, counted.LATENCY_OK) == (n, n * (10 + 2**62), float(2**62))


def test_elapsed_time_is_a_long_while_it_fits(spark, tmp_path):
    """A store whose counts were written as longs is read as before."""
    root = str(tmp_path)
    old = spark.createDataFrame([(2, 2, 7)], "IN bigint, OK bigint, ELAPSED bigint")
    assert batches.append(old, root, orders.COUNTS, "run", 0)
    counted = orders.counters(spark, root)
    assert dict(counted.dtypes)["ELAPSED"] == "bigint"
    assert (counted.first().ELAPSED, counted.first().LATENCY_OK) == (7, 3.5)


def test_large_batches_are_stored_mixed(spark, requests, lookups, tmp_path, monkeypatch):
    monkeypatch.setattr(orders, "MIXED_FROM", 7 * 150)
    root, halves = str(tmp_path), requests.randomSplit([0.5, 0.5], 4)
    for batch, some in enumerate([*halves, requests.limit(20)]):
        assert orders.process_batch(some, root, "run", batch, lookups, clock=lambda: 2_000_000_000_000)
    assert [batches.is_mixed(a) for _, a in batches.attempts(spark, root, EVENTS)] == [True, True, False]
    facts = order_facts(requests, lookups)
    stored = read_events(spark, root)
    assert rows(stored, *EVENT_COLUMNS) == rows(all_events(facts), *EVENT_COLUMNS)
    assert rows(orders.rejects(spark, root)) == rows(all_rejects(facts))
    assert rows(orders.responses(spark, root)) == rows(create_order_responses(requests))
    assert orders.counters(spark, root).first().IN == 420
