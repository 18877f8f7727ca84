"""Event store, batch tables, counters and text sinks."""

import re
import shutil
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators import counters
from orderloom.operators import events as ev
from orderloom.plans import catalog
from orderloom.plans.lifecycle import all_events, events_of_type, order_facts
from orderloom.schemas import CREATE, CREDIT, EVENT, EVENT_COLUMNS, EVENT_TYPES, PRICE, PULL, REQUEST, RESERVE, SHIP
from orderloom.sinks import batches
from orderloom.sinks import tables as sink
from orderloom.sources import tables
from orderloom.sources.event_store import follow, read_events, read_feed
from orderloom.sources.requests import read_requests
from orderloom.sources.sql_table import drop_event_table, sync_event_table


@pytest.fixture(scope="module")
def facts(spark, small):
    return order_facts(tables.requests(spark, small), tables.lookups(spark, small)).cache()


@pytest.fixture(scope="module")
def few(spark, facts):
    rows = facts.orderBy("request_id").limit(40).collect()
    return spark.createDataFrame(rows, facts.schema).cache()


@pytest.fixture(scope="module")
def store(spark, facts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "events")
    sink.append_events(all_events(facts), path)
    return path


def test_a_committed_batch_is_written_once(spark, facts, tmp_path):
    path, n = str(tmp_path / "events"), facts.count()
    assert [sink.append_events(all_events(facts), path, "a", b) for b in (0, 1, 1)] == [True, True, False]
    assert read_events(spark, path).count() == 2 * 7 * n
    # Another run with the same numbers adds its batches and touches no other's.
    assert sink.append_events(events_of_type(facts, CREATE), path, "b", 0)
    assert read_events(spark, path).count() == 2 * 7 * n + n
    assert read_events(spark, path, after=2).count() == n
    assert [p for p, _ in batches.attempts(spark, path, sink.EVENTS)] == [1, 2, 3]


def test_a_failed_attempt_is_never_read(spark, facts, tmp_path):
    path, n = str(tmp_path / "events"), facts.count()
    sink.append_events(all_events(facts), path, "a", 0)
    reader = read_events(spark, path)
    lost = batches.Batch(spark, path, "a", 1)
    lost.write(all_events(facts), sink.EVENTS, "event_name")  # ends before its commit
    assert read_events(spark, path).count() == 7 * n
    sink.append_events(events_of_type(facts, CREATE), path, "a", 1)
    assert read_events(spark, path).count() == 8 * n
    assert reader.count() == 7 * n  # a reader keeps the batches it started with


def test_compaction_keeps_rows_and_order(spark, facts, tmp_path):
    path, n = str(tmp_path / "events"), facts.count()
    for batch in range(3):
        sink.append_events(events_of_type(facts, CREATE), path, "a", batch)
    sink.compact_events(spark, path)
    assert [p for p, _ in batches.attempts(spark, path, sink.EVENTS)] == [3]
    assert read_events(spark, path).count() == 3 * n
    batches.vacuum(spark, path, sink.EVENTS)
    assert read_events(spark, path).count() == 3 * n
    assert not sink.append_events(events_of_type(facts, CREATE), path, "a", 1)
    sink.append_events(all_events(facts), path, "a", 3)
    assert read_feed(spark, path, CREATE).count() == 4 * n


def test_nothing_stored_reads_as_nothing(spark, tmp_path):
    path = str(tmp_path / "events")
    assert read_events(spark, path).count() == 0
    sink.append_events(read_events(spark, path), path)
    assert read_events(spark, path).count() == 0


def test_feed_reads_one_folder_and_its_columns(spark, store):
    feed = ev.hydrate(read_events(spark, store), CREDIT)
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_name" in plan
    assert "ReadSchema: struct<do_key:string,sequence:bigint,event_time:bigint,account_number:string,amount" in plan
    assert read_feed(spark, store, CREDIT).select("event_name").distinct().count() == 1


def sql_counts(spark, name):
    return {r.event_name: r.n for r in spark.sql(f"SELECT event_name, count(*) AS n FROM {name} GROUP BY event_name").collect()}


def counts(events):
    return {r["event_name"]: r["count"] for r in events.groupBy("event_name").count().collect()}


def test_sql_name_follows_the_log(spark, few, tmp_path):
    """After append, retention, compaction and deletion, the name shows just what ``read_events`` reads."""
    root, name = str(tmp_path / "events"), "followed_events"
    sync_event_table(spark, name, root)
    assert spark.table(name).count() == 0
    for batch, types in enumerate(([CREATE], [CREATE, CREDIT], [CREDIT, PRICE], [PRICE])):
        rows = reduce(DataFrame.unionByName, [events_of_type(few, t) for t in types])
        sink.append_events(rows, root, "a", batch)
        sync_event_table(spark, name, root)
        assert sql_counts(spark, name) == counts(read_events(spark, root))
    sink.drop_events_up_to(spark, root, 1)
    sync_event_table(spark, name, root)
    assert sql_counts(spark, name) == counts(read_events(spark, root)) == dict.fromkeys((CREATE,), few.count()) | dict.fromkeys((CREDIT, PRICE), 2 * few.count())
    sink.compact_events(spark, root)
    sync_event_table(spark, name, root)
    batches.vacuum(spark, root, sink.EVENTS)
    sync_event_table(spark, name, root)
    assert sql_counts(spark, name) == counts(read_events(spark, root))
    assert spark.sql(f"SHOW PARTITIONS {name}_files").count() == len(EVENT_TYPES)
    drop_event_table(spark, name)
    assert read_events(spark, root).count() == 5 * few.count()


def test_sql_name_never_shows_rows_twice(spark, few, tmp_path):
    """Between the steps of a change of the store, a query sees it as it was."""
    root, name = str(tmp_path / "events"), "steady_events"
    for batch in (0, 1):
        sink.append_events(events_of_type(few, CREATE), root, "a", batch)
    sync_event_table(spark, name, root)
    sink.compact_events(spark, root)
    assert spark.table(name).count() == 2 * few.count()  # not yet told of the compaction
    sync_event_table(spark, name, root)
    assert spark.table(name).count() == 2 * few.count()
    drop_event_table(spark, name)


def followed(spark, root, checkpoint, **options):
    """Events a follower gets now, as (order, type) pairs, in order."""
    got = []

    def handle(rows, run, batch_id):
        got.extend((r.do_key, r.event_name) for r in rows.collect())

    follow(spark, root, handle, checkpoint, {"availableNow": True}, **options).awaitTermination()
    return sorted(got)


def pairs(events):
    return sorted((r.do_key, r.event_name) for r in events.collect())


def test_new_follower_gets_what_a_reader_gets(spark, few, tmp_path):
    """After compaction, after retention, after both, and when the replaced files are gone."""
    root = str(tmp_path / "events")
    for batch, name in enumerate((CREATE, PRICE, CREDIT, SHIP)):
        sink.append_events(events_of_type(few, name), root, "a", batch)
    steps = [
        lambda: sink.drop_events_up_to(spark, root, 1),
        lambda: sink.compact_events(spark, root),
        lambda: batches.vacuum(spark, root, sink.EVENTS),
        lambda: sink.append_events(events_of_type(few, PULL), root, "a", 4),
        lambda: sink.compact_events(spark, root),
        lambda: batches.vacuum(spark, root, sink.EVENTS),
        lambda: sink.drop_events_up_to(spark, root, 5),
    ]
    for k, step in enumerate([lambda: None, *steps]):
        step()
        assert followed(spark, root, str(tmp_path / f"new-{k}"), commits_per_batch=2) == pairs(read_events(spark, root))


def test_follower_that_lags_behind(spark, few, tmp_path):
    """It gets each batch once: from the compaction that has it, or not at all if it was given up."""
    root, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    kinds = (CREATE, PRICE, CREDIT, SHIP, PULL)
    for batch, name in enumerate(kinds[:2]):
        sink.append_events(events_of_type(few, name), root, "a", batch)
    first = followed(spark, root, checkpoint)
    assert first == pairs(read_events(spark, root))
    for batch, name in enumerate(kinds[2:4], 2):
        sink.append_events(events_of_type(few, name), root, "a", batch)
    sink.compact_events(spark, root)
    sink.append_events(events_of_type(few, kinds[4]), root, "a", 4)
    sink.compact_events(spark, root)  # twice over
    batches.vacuum(spark, root, sink.EVENTS)
    later = followed(spark, root, checkpoint)
    assert {name for _, name in later} == set(kinds[2:]) and len(later) == 3 * few.count()
    sink.append_events(events_of_type(few, RESERVE), root, "a", 5)
    sink.drop_events_up_to(spark, root, 6)
    batches.vacuum(spark, root, sink.EVENTS)
    assert followed(spark, root, checkpoint) == []


def test_follower_from_a_time(spark, few, tmp_path):
    """It skips what ended before its time without reading it, and starts within a batch."""
    root = str(tmp_path / "events")
    for batch in range(3):
        rows = events_of_type(few, CREATE).withColumn("event_time", F.lit(1000 * batch) + F.crc32(F.col("do_key").cast("binary")) % 1000)
        sink.append_events(rows.withColumn("event_time", F.col("event_time").cast("bigint")), root, "a", batch)
    sink.append_events(events_of_type(few, PRICE).withColumn("event_time", F.lit(None).cast("bigint")), root, "a", 3)
    want = read_events(spark, root).filter("event_time >= 1500")
    assert 0 < want.count() < 2 * few.count()
    want = pairs(want)
    first = batches.attempts(spark, root, sink.EVENTS)[0][1]
    shutil.rmtree(f"{root}/{sink.EVENTS}/attempt={first}")
    assert followed(spark, root, str(tmp_path / "checkpoint"), from_ms=1500) == want


def test_retention_by_number(spark, few, tmp_path):
    n = few.count()
    for keep, left in ((0, 0), (1, 1), (n, 1), (n + 1, 2), (3 * n, 3), (100 * n, 4)):
        root = str(tmp_path / f"keep-{keep}")
        for batch in range(4):
            sink.append_events(events_of_type(few, CREATE), root, "a", batch)
        sink.keep_last_events(spark, root, keep)
        assert [p for p, _ in batches.attempts(spark, root, sink.EVENTS)] == [1, 2, 3, 4][4 - left :]
    log = batches.commits(spark, root).collect()
    assert [r.sizes[sink.EVENTS] for r in log] == [n] * 4


def test_commits_at_one_position(spark, tmp_path):
    """Two runs that commit at once share a position; their order is the same for every reader."""
    root, schema = str(tmp_path / "latest"), spark.createDataFrame([], "k string, v int").schema
    for run, value in (("b", 2), ("a", 9)):
        batch = batches.Batch(spark, root, run, 0)
        batch.write(spark.createDataFrame([("x", value)], schema), "latest")
        batch.commit(position=1)
    assert [r.v for r in sink.read_upserts(spark, root, schema, "k").collect()] == [2]


def test_retention(spark, facts, tmp_path):
    path = str(tmp_path / "events")
    for batch in (0, 1, 2):
        sink.append_events(events_of_type(facts, CREATE), path, "a", batch)
    sink.drop_events_up_to(spark, path, 2)
    sink.drop_events_up_to(spark, path, 2)
    batches.vacuum(spark, path, sink.EVENTS)
    assert [p for p, _ in batches.attempts(spark, path, sink.EVENTS)] == [3]
    assert read_events(spark, path).count() == facts.count()


def test_upserts_keep_the_last_value(spark, tmp_path):
    path = str(tmp_path / "latest")
    schema = spark.createDataFrame([], "k string, v int").schema
    for batch, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("a", None)]]):
        sink.upsert(spark.createDataFrame(rows, schema), path, "a", batch)
    assert not sink.upsert(spark.createDataFrame([("a", 9)], schema), path, "a", 1)
    for _ in range(2):
        found = sink.read_upserts(spark, path, schema, "k").collect()
        assert sorted((r.k, r.v) for r in found) == [("a", None), ("b", 1)]
        sink.compact_upserts(spark, path, schema, "k")
    assert batches.read(spark, path, "latest", schema).count() == 2


def test_requests_from_json(spark, tmp_path):
    row = ("r1", "Acct_42", "Item_10101", "Area51", 10, 1_700_000_000_000)
    spark.createDataFrame([row], REQUEST).write.json(str(tmp_path / "in"))
    assert tuple(read_requests(spark, str(tmp_path / "in"), "json").first()) == row


def test_counters(spark):
    starts = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "id int, start_ms bigint")
    stops = spark.createDataFrame([(1, 150), (2, 270), (9, 999)], "id int, stop_ms bigint")
    row = counters.api_counters(starts, stops).first()
    # The stop of 9 has no start: it completes, but adds no time.
    assert row.asDict() == {
        "IN": 3, "OK": 3, "FAIL": 0, "COMPLETE": 3, "ELAPSED": 120, "LATENCY_OK": 40.0,
    }
    none = counters.api_counters(starts, stops.limit(0)).first()
    assert (none.IN, none.OK, none.ELAPSED, none.LATENCY_OK) == (3, 0, 0, None)


def test_metric_lines_to_text(spark, tmp_path):
    starts = spark.createDataFrame([(1, 100)], "id int, start_ms bigint")
    stops = spark.createDataFrame([(1, 105)], "id int, stop_ms bigint")
    lines = counters.metric_lines(counters.api_counters(starts, stops), 1_700_000_000_000)
    sink.write_lines(lines, str(tmp_path / "lines"))
    text = [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert sorted(text) == sorted(
        f"order.create.{name} {value} 1700000000 "
        for name, value in [("IN", 1), ("OK", 1), ("FAIL", 0), ("COMPLETE", 1), ("LATENCY_OK", 5.0)]
    )


def test_event_lines_to_text(spark, facts, tmp_path):
    lines = ev.describe_events(all_events(facts))
    sink.write_lines(lines, str(tmp_path / "lines"))
    # Five of the seven types have a text form.
    assert spark.read.text(str(tmp_path / "lines")).count() == 5 * facts.count()


def test_stage_metrics_count_nothing_as_zero(spark, facts):
    found = counters.stage_metrics(events_of_type(facts, CREATE)).collect()
    assert {r.metric: r.n for r in found} == {
        "COP.completions": facts.count(), "PLP.completions": 0,
        "RIP.handleEventCalled": 0, "RIP.completions": 0,
    }


def test_timers_do_not_depend_on_the_session_zone(spark, small):
    def total():
        row = counters.api_counters(tables.api_starts(spark, small), tables.api_stops(spark, small))
        return row.first()

    utc = total()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert total() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_discard_runs_the_plan(spark):
    with pytest.raises(Exception, match="boom"):
        sink.discard(spark.range(1).select(F.raise_error(F.lit("boom"))))


def test_a_whole_load_is_the_same_rows_without_a_shuffle(spark, facts, tmp_path, monkeypatch):
    """Events come from the facts in the tasks that write them, which open a file for each type."""
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    whole, batch = str(tmp_path / "whole"), str(tmp_path / "batch")
    sink.append_events(all_events(facts), batch)
    monkeypatch.setattr(sink, "clustered", lambda events: pytest.fail("events were shuffled before the write"))
    sink.append_events(all_events(facts), whole, gather=False)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    rows = [sorted(map(repr, read_events(spark, root).drop("attempt").collect())) for root in (whole, batch)]
    assert rows[0] == rows[1] and len(rows[0]) == 7 * facts.count()


def test_the_store_of_a_folder_is_not_shuffled_by_type(spark, small, monkeypatch):
    """Neither the load nor the copies made from it."""
    from orderloom.plans import catalog

    monkeypatch.setattr(catalog, "_stores", {})
    monkeypatch.setattr(sink, "clustered", lambda events: pytest.fail("events were shuffled before the write"))
    for name in ("event_store_counts", "retained_events", "last_events"):
        catalog.QUERIES[name](spark, small).count()
    catalog._by_order(spark, small).count()


def test_a_load_in_parts_is_the_whole_load(spark, small, tmp_path):
    """Each part of the orders is a batch of its own."""
    roots = [str(tmp_path / str(parts)) for parts in (1, 3)]
    for root, parts in zip(roots, (1, 3)):
        catalog._load(spark, small, root, parts)
    whole, loaded = (sorted(map(tuple, read_events(spark, r).select(*EVENT_COLUMNS).collect()), key=repr) for r in roots)
    assert loaded == whole
    assert [len(batches.attempts(spark, r, sink.EVENTS)) for r in roots] == [1, 3]


def test_a_large_load_goes_in_parts(spark, tmp_path, monkeypatch):
    lines = spark.range(100).select(*[F.col("id").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")])
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert catalog._load_parts(spark, str(tmp_path)) == 1
    monkeypatch.setattr(catalog, "PART_LINES", 30)
    assert catalog._load_parts(spark, str(tmp_path)) == 3
    monkeypatch.setattr(catalog, "PART_LINES", 2)
    assert catalog._load_parts(spark, str(tmp_path)) == catalog.MOST_PARTS


def test_a_write_leaves_no_shuffle_behind(spark, tmp_path):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size())}

    batch, rows = batches.Batch(spark, str(tmp_path), "load", 0), spark.range(1000).repartition(3, "id")
    before = shuffled()
    batch.write(rows, "numbers")
    assert not [f for f in shuffled() - before if f.startswith("shuffle")]
    batch.commit()
    assert batches.read(spark, str(tmp_path), "numbers", rows.schema).count() == 1000


def test_order_numbers_are_stored_by_what_they_share(spark, tmp_path):
    rows = spark.range(20_000).select(F.format_string("%012d", "id").alias("do_key")).coalesce(1)
    batches.append(rows, str(tmp_path), "keys", "load", 0)
    rows.write.option("compression", "zstd").parquet(str(tmp_path / "plain"))
    size = [sum(f.stat().st_size for f in (tmp_path / name).rglob("*.parquet")) for name in ("keys", "plain")]
    assert size[0] < size[1] / 2
    assert batches.read(spark, str(tmp_path), "keys", rows.schema).collect() == rows.collect()


def test_spans_of_orders_are_all_orders_once(spark, small):
    spans = tables.order_spans(spark, small, 3)
    assert len(spans) == 3 and spans[0][0] is spans[-1][1] is None
    assert all(before[1] == after[0] for before, after in zip(spans, spans[1:]))
    parts = [tables.requests(spark, small, span=span).collect() for span in spans]
    assert sorted(sum(parts, []), key=repr) == sorted(tables.requests(spark, small).collect(), key=repr)
    assert max(map(len, parts)) < 2 * min(map(len, parts))


def test_orders_without_a_number_are_in_the_last_span(spark):
    rows = spark.createDataFrame([(1,), (5,), (5,), (9,), (None,)], "k bigint")
    spans = [(None, 5), (5, 5), (5, None)]
    assert [sorted(r.k or 0 for r in tables._within(rows, "k", s).collect()) for s in spans] == [[1], [], [0, 5, 5, 9]]
    assert tables._within(rows, "k", (None, None)).count() == 5


def test_a_part_of_a_load_does_not_shuffle_the_stock(spark, small, tmp_path):
    """Saved prices and stock are read by item as they lie, and gone with what they shuffled when the load ends."""

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle")}

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before, known = shuffled(), {t.name for t in spark.catalog.listTables()}
    try:
        with tables.lookups_by_item(tables.lookups(spark, small), str(tmp_path / "lookups")) as saved:
            assert not shuffled() - before
            wanted = tables.lookups(spark, small)
            for name in ("prices", "balances", "stock"):
                got, full = (sorted(map(tuple, getattr(x, name).collect())) for x in (saved, wanted))
                assert got == full
            facts_of = order_facts(tables.requests(spark, small), saved)
            plan = facts_of._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning\(item_number", plan)) == 1  # the requests
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not (tmp_path / "lookups").exists() and {t.name for t in spark.catalog.listTables()} == known


def test_a_load_in_parts_keeps_no_lookups(spark, small, tmp_path):
    catalog._load(spark, small, str(tmp_path / "store"), 2)
    assert [f.name for f in tmp_path.iterdir()] == ["store"]


def test_saved_lookups_by_item_reject_a_repeated_key(spark, small, tmp_path):
    full = tables.lookups(spark, small)
    doubled = full._replace(prices=full.prices.union(full.prices.limit(1)))
    with pytest.raises(ValueError, match="item_number"):
        with tables.lookups_by_item(doubled, str(tmp_path / "lookups")):
            pytest.fail("a repeated key was taken")
    assert not (tmp_path / "lookups").exists()


def test_columns_of_a_batch_share_pages(spark, tmp_path):
    """Order numbers of 20,000 rows a page, the default, take more."""
    key = F.concat_ws("-", "id", (F.xxhash64("id") % 100_000), (F.xxhash64("id", F.lit(1)) % 1000))
    rows = spark.range(200_000).coalesce(1).select(key.alias("do_key"))
    batches.append(rows, str(tmp_path), "keys", "load", 0)
    plain = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
    rows.write.options(**plain).parquet(str(tmp_path / "plain"))
    size = [sum(f.stat().st_size for f in (tmp_path / name).rglob("*.parquet")) for name in ("keys", "plain")]
    assert size[0] < 0.97 * size[1]


def test_a_mixed_batch_takes_a_fraction_of_the_disk(spark, tmp_path):
    """Seven events of an order that follow each other store about once what they share."""
    n, reached = 30_000, ("created", "priced", "credited", "reserved", "paid", "shipped")
    some = F.xxhash64("id")
    facts = spark.range(n).coalesce(1).select(
        F.concat_ws("-", "id", some % 100_000).alias("do_key"),
        *[F.concat(F.lit(c), some % k).alias(c) for c, k in (("account_number", 997), ("item_number", 4999), ("location", 99))],
        (F.col("id") % 50).cast("int").alias("quantity"),
        *[F.lit(1).cast("bigint").alias(c) for c in ("event_time", "price_cents", "amount_cents")],
        F.lit(None).cast("string").alias("stock_failure"),
        F.lit(True).alias("approved"),
        *[F.lit(True).alias(c) for c in reached],
    )
    for name, mixed in (("types", False), ("mixed", True)):
        sink.append_events(all_events(facts), str(tmp_path / name), gather=False, mixed=mixed)
    size = [sum(f.stat().st_size for f in (tmp_path / name).rglob("*.parquet")) for name in ("types", "mixed")]
    assert size[1] < size[0] / 2
    stored = [read_events(spark, str(tmp_path / name)).select(*EVENT_COLUMNS) for name in ("types", "mixed")]
    assert stored[0].exceptAll(stored[1]).isEmpty() and [rows.count() for rows in stored] == [7 * n] * 2


def test_a_large_load_keeps_an_orders_events_together(spark, small, tmp_path):
    catalog._load(spark, small, str(tmp_path / "store"), 2)
    assert not list((tmp_path / "store").rglob("event_name=*"))
    file = max((tmp_path / "store" / "events").rglob("*.parquet"), key=lambda f: f.stat().st_size)
    keys = [r.do_key for r in spark.read.parquet(str(file)).select("do_key").collect()]
    assert len(keys) == 7 * len(set(keys)) and keys == sorted(keys)


def test_mixed_batches_are_batches(spark, facts, tmp_path):
    """Beside batches by type: feeds, followers, retention, the SQL name, compaction and deletion."""
    root, events = str(tmp_path / "store"), all_events(facts)
    halves = [events.filter(F.crc32("do_key") % 2 == half) for half in (0, 1)]
    name = f"mixed_{tmp_path.name}".replace("-", "_")

    def rows(found):
        return sorted(map(repr, found.select(*EVENT_COLUMNS).collect()))

    sync_event_table(spark, name, root)
    for batch, half in enumerate(halves):
        assert sink.append_events(half, root, batch_id=batch, mixed=batch == 0)
        assert not sink.append_events(half, root, batch_id=batch, mixed=True)
        sync_event_table(spark, name, root)
    first, second = batches.attempts(spark, root, sink.EVENTS)
    assert batches.is_mixed(first[1]) and not batches.is_mixed(second[1])
    whole = rows(events)
    assert rows(read_events(spark, root)) == rows(spark.table(name)) == whole
    assert rows(read_events(spark, root, after=1)) == rows(halves[1])
    assert {r.attempt for r in read_events(spark, root).select("attempt").distinct().collect()} == {first[1], second[1]}
    assert rows(read_feed(spark, root, CREDIT)) == rows(events.filter(F.col("event_name") == CREDIT))
    sink.compact_events(spark, root)
    batches.vacuum(spark, root, sink.EVENTS)
    sync_event_table(spark, name, root)
    assert rows(read_events(spark, root)) == rows(spark.table(name)) == whole
    origin = batches.read_origins(spark, root, sink.EVENTS, EVENT, [first[1]])
    assert rows(origin) == rows(halves[0])
    drop_event_table(spark, name)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(name)]
    other = str(tmp_path / "other")
    for batch, half in enumerate(halves):
        sink.append_events(half, other, batch_id=batch, mixed=True)
    sink.keep_last_events(spark, other, 1)
    assert rows(read_events(spark, other)) == rows(halves[1])
