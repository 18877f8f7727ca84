"""The copy bucketed by order: the same rows, and no shuffle."""

import uuid

import pytest
from pyspark.sql import functions as F

from orderloom.operators import pairing, stages
from orderloom.operators.events import event_feed
from orderloom.operators.view import order_view
from orderloom.plans import catalog
from orderloom.schemas import CREDIT, EVENT_COLUMNS, RESERVE
from orderloom.sinks import batches
from orderloom.sinks.by_order import append_by_order, bucket_by_order, order_table, read_by_order, read_orders
from orderloom.sinks.tables import EVENTS, append_events, compact_events, drop_events_up_to
from orderloom.sources.event_store import read_events


def rows(df):
    return sorted((tuple(r) for r in df.select(*EVENT_COLUMNS).collect()), key=repr)


@pytest.fixture
def store(spark, small, tmp_path):
    """Root of a store of three batches, and a name."""
    stored = read_events(spark, catalog.store_path(spark, small)).select(*EVENT_COLUMNS)
    for third in range(3):
        append_events(stored.filter(F.crc32("do_key") % 3 == third).limit(200), str(tmp_path), "load", third)
    return str(tmp_path), f"orders_{uuid.uuid4().hex}"


def test_reads_what_the_store_has(spark, small, store):
    root, name = store
    bucket_by_order(spark, name, root)
    assert rows(read_by_order(spark, name, root)) == rows(read_events(spark, root)) == rows(spark.table(name))
    more = read_events(spark, root).filter(F.col("event_name") == CREDIT)
    append_events(more, root, "more", 0)
    assert rows(read_by_order(spark, name, root)) == rows(read_events(spark, root))
    drop_events_up_to(spark, root, 1)
    assert rows(read_by_order(spark, name, root)) == rows(read_events(spark, root))
    compact_events(spark, root)
    batches.vacuum(spark, root, EVENTS)
    assert rows(read_by_order(spark, name, root)) == rows(read_events(spark, root))
    bucket_by_order(spark, name, root, 3)
    assert rows(read_by_order(spark, name, root)) == rows(read_events(spark, root)) == rows(spark.table(name))


def test_empty_store(spark, tmp_path):
    name = f"orders_{uuid.uuid4().hex}"
    bucket_by_order(spark, name, str(tmp_path))
    assert rows(read_by_order(spark, name, str(tmp_path))) == []


def test_pairs_and_fold_do_not_shuffle(spark, small):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = catalog._by_order(spark, small)
        sides = [stages.side_of(event_feed(stored, n).select(*EVENT_COLUMNS), n) for n in (CREDIT, RESERVE)]
        for df in (pairing.pair(*sides, check=False), pairing.pending_pairs(*sides, check=False), order_view(stored)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
            assert "Bucketed: true" in plan
        checked = pairing.pair(*sides)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in checked
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_load_in_parts_needs_no_shuffle_by_order(spark, small, tmp_path, monkeypatch):
    """Feeds joined with the fold read the buckets that the load wrote, with or without rows in each part."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    wanted = catalog.QUERIES["enriched_price_events"](spark, small).collect()
    root = str(tmp_path / "store")
    spans = catalog.tables.order_spans(spark, small, 2)
    cut = spans[0][1]
    monkeypatch.setattr(catalog.tables, "order_spans", lambda *_: [spans[0], (cut, cut), spans[1]])
    catalog._load(spark, small, root, 3)
    monkeypatch.setattr(catalog, "store_path", lambda *_: root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("enriched_price_events", "balance_requests", "reserve_requests"):
            plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = catalog.QUERIES["enriched_price_events"](spark, small).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    assert len(batches.attempts(spark, root, EVENTS)) == 3 and read_events(spark, root).count() == 7 * len(wanted)


def test_orders_are_read_whole_whatever_comes_to_their_store(spark, small, tmp_path):
    root, name = str(tmp_path / "store"), f"orders_{uuid.uuid4().hex}"
    events = catalog._stored(spark, small).select(*EVENT_COLUMNS)

    def same(found, rows):
        return found.select(*EVENT_COLUMNS).exceptAll(rows).isEmpty() and found.count() == rows.count()

    halves = [events.filter(F.crc32("do_key") % 2 == half) for half in (0, 1)]
    order_table(spark, name, root, 4)
    try:
        assert append_by_order(halves[0], root, name) and not append_by_order(halves[0], root, name)
        assert same(read_orders(spark, name, root), halves[0])
        append_events(halves[1], root, batch_id=1)
        assert same(read_orders(spark, name, root), events) and same(read_events(spark, root), events)
        compact_events(spark, root)
        batches.vacuum(spark, root, EVENTS)
        assert same(read_orders(spark, name, root), events)
    finally:
        spark.sql(f"DROP TABLE {name}")
