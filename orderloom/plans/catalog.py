"""Registered queries: each takes a session and a data folder and returns a DataFrame.

Decimals leave as whole cents. Queries on the event store write the store once per session
and data folder, into the shared folder, and read it back like any other consumer.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.money import to_cents
from orderloom.functions.text import order_line
from orderloom.operators import counters, events, ordered_pairing, pairing, stages, view
from orderloom.plans import lifecycle
from orderloom.schemas import (
    CREATE,
    CREDIT,
    EVENT,
    EVENT_COLUMNS,
    EVENT_TYPES,
    PAYMENT,
    PRICE,
    PULL,
    RESERVE,
    SHIP,
)
from orderloom.session import new_folder
from orderloom.sinks import batches
from orderloom.sinks.by_order import KEY, append_by_order, bucket_by_order, order_table, read_by_order, read_orders
from orderloom.sinks.numbering import append_numbered
from orderloom.sinks.tables import EVENTS, append_events, compact_events, drop_events_up_to, keep_last_events
from orderloom.sources import tables
from orderloom.sources.event_store import follow, read_events, read_feed
from orderloom.sources.requests import stream_requests
from orderloom.sources.sql_table import sync_event_table
from orderloom.streaming import orders
from orderloom.streaming.pairing import Pairing, pairing_rows
from orderloom.streaming.snapshots import given_clock, run_snapshots, snapshots
from orderloom.streaming.timers import Timers
from orderloom.streaming.view import MaintainedView

Query = Callable[[SparkSession, str], DataFrame]

METRIC_EPOCH_MS = 1_700_000_000_123
SNAPSHOT_STEP_MS = 5_000
SUBSCRIBE_FROM_MS = 893_000_000_000
KNOWN_USER_EVENTS = ("click", "purchase", "signup", "view")
ALL_FILES_NOW = {"availableNow": True}
KEEP_EVENTS = 20_000
# Orders of every second and fourth number, and how much less they cost in the later batches.
LATER_PRICES = ((2, "1.00"), (4, "0.50"))

# A whole load goes in a part for so many line items, and in so many parts at most: what a part shuffles
# is gone before the next one, while each part reads the tables again.
PART_LINES, MOST_PARTS = 1 << 19, 24

# Event stores written in this session, by what wrote them and data folder.
_stores: dict[tuple[str, str, str], str] = {}


def _facts(spark: SparkSession, folder: str, **options) -> DataFrame:
    requests = tables.requests(spark, folder)
    return lifecycle.order_facts(requests, tables.lookups(spark, folder), **options)


def _once(spark: SparkSession, folder: str, purpose: str, fill: Callable[[str], None]) -> str:
    """A fresh shared folder, filled on first use in a session."""
    key = (spark.sparkContext.applicationId, folder, purpose)
    if key not in _stores:
        path = new_folder(spark, purpose)
        fill(path)
        _stores[key] = path
    return _stores[key]


def _lines(spark: SparkSession, folder: str) -> int:
    """The files' footers have the number of line items."""
    return tables.table(spark, folder, "lineitem").count()


def _load_parts(spark: SparkSession, folder: str) -> int:
    """How many batches a whole load is."""
    return max(1, min(MOST_PARTS, _lines(spark, folder) // PART_LINES))


def _order_buckets(spark: SparkSession, folder: str) -> int:
    """Buckets of the orders of a load in parts; they grow in number with it, and not in size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), _lines(spark, folder) // PART_LINES)


def _order_table(root: str) -> str:
    return f"orders_of_{zlib.crc32(root.encode())}"


def _load(spark: SparkSession, folder: str, path: str, parts: int) -> None:
    """All events of a data folder in one batch for each part of its orders.

    Lookups are saved and checked once for all parts. Parts are spans of order numbers and events are
    written by order, as neighbours' numbers then share most of their digits. A load of one part has a folder
    for each type; with more, the seven events of an order are kept together, which takes a fraction of the disk,
    and orders are dealt to buckets.
    """
    lookups = tables.lookups(spark, folder)
    if parts == 1:
        facts = lifecycle.order_facts(tables.requests(spark, folder), lookups).sortWithinPartitions(KEY)
        append_events(lifecycle.all_events(facts), path, gather=False)
        return
    buckets, name = _order_buckets(spark, folder), _order_table(path)
    order_table(spark, name, path, buckets)
    with tables.lookups_by_item(lookups, f"{path}-lookups") as saved:
        for part, span in enumerate(tables.order_spans(spark, folder, parts)):
            facts = lifecycle.order_facts(tables.requests(spark, folder, span=span), saved)
            facts = facts.repartition(buckets, KEY).sortWithinPartitions(KEY)
            append_by_order(lifecycle.all_events(facts), path, name, batch_id=part)


def store_path(spark: SparkSession, folder: str) -> str:
    """Root of the stored events of a data folder, written on first use."""
    return _once(
        spark, folder, "order-events", lambda path: _load(spark, folder, path, _load_parts(spark, folder))
    )


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return read_events(spark, store_path(spark, folder))


def _stored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The same for joins and folds by order, which need no shuffle if the load was in parts."""
    root = store_path(spark, folder)
    name = _order_table(root)
    return read_orders(spark, name, root) if spark.catalog.tableExists(name) else read_events(spark, root)


def _append_copy(spark: SparkSession, folder: str, stored: DataFrame, root: str, batch_id: int) -> None:
    """Stored events once more, as a load keeps them: mixed, as they are read, if that was in parts."""
    mixed = _load_parts(spark, folder) > 1
    append_events(stored, root, "load", batch_id, gather=False, mixed=mixed)


def _cents(column: str = "amount", name: str = "amount_cents") -> Column:
    return to_cents(F.col(column)).alias(name)


def _ordered(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select(F.col("do_key").alias("order_number"), *columns)


# Requests and the seven event types


def order_requests(spark: SparkSession, folder: str) -> DataFrame:
    return tables.requests(spark, folder)


def create_order_events(spark: SparkSession, folder: str) -> DataFrame:
    created = events.create_order_events(tables.requests(spark, folder))
    return created.select("do_key", "sequence", "event_name", "event_time", *EVENT_TYPES[CREATE].fields)


def create_order_responses(spark: SparkSession, folder: str) -> DataFrame:
    return events.create_order_responses(tables.requests(spark, folder))


def price_lookup_events(spark: SparkSession, folder: str) -> DataFrame:
    created = events.create_order_events(tables.requests(spark, folder))
    priced = stages.price_lookup(created, tables.prices(spark, folder)).events
    return _ordered(priced, "item_number", "location", "quantity", _cents(name="price_cents"))


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Stored PriceLookup events with the view folded from the same store."""
    stored = _stored_orders(spark, folder)
    priced = events.event_feed(stored, PRICE).select(*EVENT_COLUMNS)
    return stages.enrich(priced, view.order_view(stored)).events


def enriched_price_events(spark: SparkSession, folder: str) -> DataFrame:
    account = F.col("order.account_number").alias("account_number")
    price = _cents(name="price_cents")
    return _ordered(_enriched(spark, folder), "item_number", "location", "quantity", price, account)


def credit_check_events(spark: SparkSession, folder: str) -> DataFrame:
    lookups = tables.lookups(spark, folder)._replace(stock=None)
    facts = lifecycle.order_facts(tables.requests(spark, folder), lookups)
    credit = lifecycle.events_of_type(facts, CREDIT)
    return _ordered(credit, "account_number", _cents(), "approved")


def reserve_inventory_events(spark: SparkSession, folder: str) -> DataFrame:
    lookups = tables.lookups(spark, folder)._replace(balances=None)
    facts = lifecycle.order_facts(tables.requests(spark, folder), lookups)
    reserve = lifecycle.events_of_type(facts, RESERVE)
    return _ordered(reserve, *EVENT_TYPES[RESERVE].fields)


# What each step asks the services for


def price_requests(spark: SparkSession, folder: str) -> DataFrame:
    created = events.create_order_events(tables.requests(spark, folder))
    return _ordered(stages.price_requests(created), "item_number")


def balance_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _ordered(stages.balance_requests(_enriched(spark, folder)), "account_number")


def reserve_requests(spark: SparkSession, folder: str) -> DataFrame:
    asked = stages.reserve_requests(_enriched(spark, folder))
    return _ordered(asked, "item_number", "location", "quantity")


def pull_requests(spark: SparkSession, folder: str) -> DataFrame:
    asked = stages.pull_requests(_credit_reserve(spark, folder))
    return _ordered(asked, "item_number", "location", "quantity")


def _side(spark: SparkSession, folder: str, name: str) -> DataFrame:
    stored = read_feed(spark, store_path(spark, folder), name)
    return stages.side_of(stored, name)


def _credit_reserve(spark: SparkSession, folder: str) -> DataFrame:
    return pairing.pair(_side(spark, folder, CREDIT), _side(spark, folder, RESERVE))


def _credit_reserve_columns(pairs: DataFrame) -> DataFrame:
    return _ordered(
        pairs,
        _cents("left.amount"),
        F.col("left.approved").alias("approved"),
        "right.account_number",
        "right.item_number",
        "right.location",
        "right.quantity",
        "right.description",
    )


def combo_credit_reserve(spark: SparkSession, folder: str) -> DataFrame:
    return _credit_reserve_columns(_credit_reserve(spark, folder))


def payment_requests(spark: SparkSession, folder: str) -> DataFrame:
    asked = stages.payment_requests(_credit_reserve(spark, folder))
    return asked.select("account_number", "amount_cents")


def payment_events(spark: SparkSession, folder: str) -> DataFrame:
    paid = stages.collect_payment(_credit_reserve(spark, folder))
    return _ordered(paid, "account_number", _cents())


def pull_inventory_events(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _credit_reserve(spark, folder)
    pulled = stages.pull_inventory(pairs, tables.stock(spark, folder)).events
    return _ordered(pulled, *EVENT_TYPES[PULL].fields)


def _payment_pull(spark: SparkSession, folder: str) -> DataFrame:
    return pairing.pair(_side(spark, folder, PAYMENT), _side(spark, folder, PULL))


def combo_payment_pull(spark: SparkSession, folder: str) -> DataFrame:
    return _ordered(
        _payment_pull(spark, folder),
        _cents("left.amount"),
        "right.account_number",
        "right.item_number",
        "right.location",
        "right.quantity",
        "right.description",
    )


def ship_order_events(spark: SparkSession, folder: str) -> DataFrame:
    shipped = stages.ship_order(_payment_pull(spark, folder))
    return _ordered(shipped, *EVENT_TYPES[SHIP].fields)


def shippable_orders(spark: SparkSession, folder: str) -> DataFrame:
    facts = _facts(spark, folder, require_success=True)
    return _ordered(lifecycle.events_of_type(facts, SHIP), *EVENT_TYPES[SHIP].fields)


def order_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without line items ask for no item, which no lookup has."""
    requests = tables.requests(spark, folder, "right")
    facts = lifecycle.order_facts(requests, tables.lookups(spark, folder))
    return _ordered(lifecycle.all_rejects(facts), "stage", "reason")


def pending_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders placed against first shipments; an order without line items waits for its own."""
    sides = tables.placed(spark, folder), tables.shipped(spark, folder)
    return pairing.missing_side(pairing.pending_pairs(*sides, "o_orderkey"), "o_orderkey")


def order_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.lifecycle_summary(_facts(spark, folder))


# Order view and event store


def _view_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "order_number",
        "account_number",
        "item_number",
        "location",
        _cents("unit_price", "price_cents"),
        "quantity",
    )


def order_view(spark: SparkSession, folder: str) -> DataFrame:
    """The fold of all events; of many, in the parts of a load, as an order's events are all in one of them.

    What a part shuffles is gone before the next one.
    """
    parts = _load_parts(spark, folder)
    if parts == 1:
        return _view_columns(view.order_view(lifecycle.all_events(_facts(spark, folder))))
    path = new_folder(spark, "order-view")
    with tables.lookups_by_item(tables.lookups(spark, folder), f"{path}-lookups") as saved, batches.cleaned_up(spark):
        for span in tables.order_spans(spark, folder, parts):
            facts = lifecycle.order_facts(tables.requests(spark, folder, span=span), saved)
            rows = _view_columns(view.order_view(lifecycle.all_events(facts)))
            rows.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def order_view_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return _view_columns(view.order_view_as_of(_stored(spark, folder), 4))


def order_view_direct(spark: SparkSession, folder: str) -> DataFrame:
    prices_only = tables.lookups(spark, folder)._replace(balances=None, stock=None)
    facts = lifecycle.order_facts(tables.requests(spark, folder), prices_only)
    return _view_columns(lifecycle.current_view(facts))


def view_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The log with a reservation for each whole order, under a number nobody created."""
    given = {
        "do_key": F.col("o_orderkey"),
        "sequence": F.lit(EVENT_TYPES[RESERVE].sequence),
        "event_name": F.lit(RESERVE),
    }
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT]
    strays = tables.table(spark, folder, "orders").select(*columns)
    log = _stored(spark, folder).select(*EVENT_COLUMNS).unionByName(strays)
    return _ordered(view.view_rejects(log), "stage", "reason")


def order_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    current = view.order_view(_stored(spark, folder))
    return current.select("order_number", order_line().alias("line"))


def event_feed_by_type(spark: SparkSession, folder: str) -> DataFrame:
    feed = events.event_feed(_stored(spark, folder), CREDIT)
    return feed.select("do_key", "sequence", "account_number", _cents(), "approved")


def subscribe_order_created(spark: SparkSession, folder: str) -> DataFrame:
    return events.subscribe_order_created(_stored(spark, folder), SUBSCRIBE_FROM_MS)


def _hydrate(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        typed = events.hydrate(_stored(spark, folder), name)
        if "amount" in typed.columns:
            typed = typed.withColumn("amount_cents", _cents()).drop("amount")
        return typed

    return query


def event_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    return events.describe_events(_stored(spark, folder))


def event_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return events.round_trip_mismatches(_stored(spark, folder))


def event_store_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counters.event_counts(_stored(spark, folder))


def stage_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return counters.stage_metrics(_stored(spark, folder))


def sql_event_history(spark: SparkSession, folder: str) -> DataFrame:
    events.register_event_view(_stored(spark, folder), "order_events")
    return spark.sql("SELECT do_key, sequence, event_name FROM order_events")


# Counters


def api_counters(spark: SparkSession, folder: str) -> DataFrame:
    return counters.api_counters(
        tables.api_starts(spark, folder), tables.api_stops(spark, folder)
    )


def metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    return counters.metric_lines(api_counters(spark, folder), METRIC_EPOCH_MS)


# User events


def latest_event_per_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_type").alias("event_name"),
        "value",
        "ts",
        "event_id",
    )
    return view.latest_per_key(rows, "key", "ts", "event_id").select("key", "event_name", "value")


def unknown_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "events")
    unknown = events.unknown_events(rows, KNOWN_USER_EVENTS, "event_type")
    return unknown.select("event_id", "event_type")


def _clicks(rows: DataFrame) -> dict:
    """What the pairing operators take: clicks are left, purchases right, users the keys."""
    return {
        "rows": rows.filter(F.col("event_type").isin("click", "purchase")),
        "key": F.col("user_id"),
        "order_by": [F.col("ts"), F.col("event_id")],
        "is_left": F.col("event_type") == "click",
        "value": F.col("event_id"),
    }


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select("key", F.col("left").alias("left_id"), F.col("right").alias("right_id"))


def _settled(spark: SparkSession, folder: str) -> ordered_pairing.Settled:
    clicks = _clicks(tables.table(spark, folder, "events"))
    return ordered_pairing.settle(clicks.pop("rows"), **clicks)


def pair_clicks_purchases(spark: SparkSession, folder: str) -> DataFrame:
    settled = _settled(spark, folder)
    return _ids(settled.pairs())


def pending_clicks_purchases(spark: SparkSession, folder: str) -> DataFrame:
    settled = _settled(spark, folder)
    return _ids(settled.open_rows())


# Streams, run to the end of what has arrived


def _arrive(requests: DataFrame, path: str) -> None:
    """Requests as files, of which there are no more than parts of a load: few batches, whatever the shuffle partitions."""
    requests.coalesce(MOST_PARTS).write.mode("append").parquet(path)


def _run_orders(spark: SparkSession, root: str, folder: str, arriving: str, **options) -> None:
    """Streams the requests of one folder into the store at ``root``, as a run of its own."""
    lookups = tables.saved_lookups(tables.lookups(spark, folder), f"{arriving}-lookups")
    requests = stream_requests(spark, arriving, files_per_batch=4)
    query = orders.run_orders(
        requests, root, lambda: lookups, f"{arriving}-checkpoint", ALL_FILES_NOW, **options
    )
    query.awaitTermination()


def _log_columns(spark: SparkSession, root: str) -> DataFrame:
    stored = read_events(spark, root)
    return stored.select(
        "do_key", "sequence", "event_name", "event_time", _cents(), "approved", "description"
    )


def stream_order_events(spark: SparkSession, folder: str) -> DataFrame:
    root = new_folder(spark, "orders")
    _arrive(tables.requests(spark, folder), f"{root}-requests")
    _run_orders(spark, root, folder, f"{root}-requests")
    return _log_columns(spark, root)


def _two_runs(spark: SparkSession, folder: str) -> str:
    """Store that two streams wrote, each with half of the requests and its own checkpoint."""

    def fill(root: str) -> None:
        requests = tables.requests(spark, folder)
        for half in (0, 1):
            arriving = f"{root}-requests-{half}"
            _arrive(requests.filter(F.crc32(F.col("request_id").cast("binary")) % 2 == half), arriving)
            _run_orders(spark, root, folder, arriving)

    return _once(spark, folder, "two-runs", fill)


def stream_two_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _log_columns(spark, _two_runs(spark, folder))


def _repeated(spark: SparkSession, folder: str) -> str:
    """Store of a stream that every request reaches twice, in batches of its own each time."""

    def fill(root: str) -> None:
        requests = tables.requests(spark, folder)
        for _ in range(2):
            _arrive(requests, f"{root}-requests")
        _run_orders(spark, root, folder, f"{root}-requests", clock=lambda: METRIC_EPOCH_MS)

    return _once(spark, folder, "repeated", fill)


def stream_repeated_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _log_columns(spark, _repeated(spark, folder))


def stream_api_counters(spark: SparkSession, folder: str) -> DataFrame:
    return orders.counters(spark, _repeated(spark, folder))


def retained_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of orders with odd numbers, after those of even ones were stored and given up."""

    def fill(root: str) -> None:
        stored = _stored(spark, folder)
        number = F.split("do_key", "-")[0].cast("bigint")
        for half in (0, 1):
            _append_copy(spark, folder, stored.filter(number % 2 == half), root, half)
        drop_events_up_to(spark, root, 1)

    root = _once(spark, folder, "retained", fill)
    return read_events(spark, root).select("do_key", "sequence", "event_name")


def _part(column: str, parts: int) -> Column:
    return F.split(column, "-")[0].cast("bigint") % parts


def _thirds(spark: SparkSession, folder: str, root: str) -> None:
    """Three batches of events by order number."""
    for third in range(3):
        part = _stored(spark, folder).filter(_part("do_key", 3) == third)
        _append_copy(spark, folder, part, root, third)


def _reworked(spark: SparkSession, folder: str) -> str:
    """Store that gave up its first third, then put the others together, and deleted what that replaced."""

    def fill(root: str) -> None:
        _thirds(spark, folder, root)
        drop_events_up_to(spark, root, 1)
        compact_events(spark, root)
        batches.vacuum(spark, root, EVENTS)

    return _once(spark, folder, "reworked", fill)


def sql_events_after_rework(spark: SparkSession, folder: str) -> DataFrame:
    """SQL access to a store whose name was made at its first batch, and followed the log since."""
    name = f"events_{uuid.uuid4().hex}"

    def fill(root: str) -> None:
        _thirds(spark, folder, root)
        sync_event_table(spark, name, root)
        drop_events_up_to(spark, root, 1)
        sync_event_table(spark, name, root)
        compact_events(spark, root)
        sync_event_table(spark, name, root)
        batches.vacuum(spark, root, EVENTS)

    fill(new_folder(spark, "sql-events"))
    return spark.sql(f"SELECT do_key, sequence, event_name FROM {name}")


def stream_after_rework(spark: SparkSession, folder: str) -> DataFrame:
    """What a new follower copies from a store after retention, compaction and deletion."""
    store, root = _reworked(spark, folder), new_folder(spark, "copy")
    follow(
        spark, store, lambda rows, run, n: append_events(rows, root, run, n), f"{root}-checkpoint", ALL_FILES_NOW,
        commits_per_batch=2,
    ).awaitTermination()
    return read_events(spark, root).select("do_key", "sequence", "event_name")


def stream_subscribe_order_created(spark: SparkSession, folder: str) -> DataFrame:
    """The subscription as a stream that starts at an event time."""
    store, root = _reworked(spark, folder), new_folder(spark, "subscribed")
    follow(
        spark, store, lambda rows, run, n: append_events(events.event_feed(rows, CREATE), root, run, n),
        f"{root}-checkpoint", ALL_FILES_NOW, from_ms=SUBSCRIBE_FROM_MS,
    ).awaitTermination()
    return events.subscribe_order_created(read_events(spark, root))


def last_events(spark: SparkSession, folder: str) -> DataFrame:
    """Retention by number: the batches that hold the last ``KEEP_EVENTS`` events."""

    def fill(root: str) -> None:
        _thirds(spark, folder, root)
        keep_last_events(spark, root, KEEP_EVENTS)

    return read_events(spark, _once(spark, folder, "last-events", fill)).select("do_key", "sequence", "event_name")


def _numbered(spark: SparkSession, folder: str) -> str:
    """Store that numbers events itself, fed by a stream: all events, then lower prices, then others again."""

    def fill(root: str) -> None:
        everything = _stored(spark, folder).select(*EVENT_COLUMNS)
        prices = everything.filter(F.col("event_name") == PRICE)
        _append_copy(spark, folder, everything, f"{root}-source", 0)
        for batch, (parts, less) in enumerate(LATER_PRICES, 1):
            changed = prices.filter(_part("do_key", parts) == 0).withColumns(
                {
                    "event_time": F.col("event_time") + 1000 * batch,
                    "amount": (F.col("amount") - F.lit(less).cast("decimal(5,2)")).cast(EVENT["amount"].dataType),
                }
            )
            append_events(changed, f"{root}-source", "load", batch)
        follow(
            spark, f"{root}-source", lambda rows, run, n: append_numbered(rows, root, run, n), f"{root}-checkpoint",
            ALL_FILES_NOW, commits_per_batch=1,
        ).awaitTermination()

    return _once(spark, folder, "numbered", fill)


def stream_numbered_events(spark: SparkSession, folder: str) -> DataFrame:
    return read_events(spark, _numbered(spark, folder)).select("do_key", "sequence", "event_name", "event_time", _cents())


def stream_numbered_view(spark: SparkSession, folder: str) -> DataFrame:
    """The view with the price that came last, though it is the lower one."""
    return _view_columns(view.order_view(read_events(spark, _numbered(spark, folder))))


def stream_order_view(spark: SparkSession, folder: str) -> DataFrame:
    root, store = new_folder(spark, "view"), _two_runs(spark, folder)
    kept = MaintainedView(spark, root)
    follow(
        spark, store, kept.handle, f"{root}-checkpoint", ALL_FILES_NOW, commits_per_batch=2
    ).awaitTermination()
    return _view_columns(kept.view())


def stream_combo_credit_reserve(spark: SparkSession, folder: str) -> DataFrame:
    root, store = new_folder(spark, "combo"), _two_runs(spark, folder)
    fields = ("amount", "approved", "description")
    kept = Pairing(spark, root, EVENT["do_key"].dataType, T.StructType([EVENT[f] for f in fields]))

    def handle(rows: DataFrame, run: str, batch_id: int) -> None:
        sides = rows.filter(F.col("event_name").isin(CREDIT, RESERVE))
        is_left = F.col("event_name") == CREDIT
        value = F.struct(*[F.col(f) for f in fields])
        kept.handle(pairing_rows(sides, F.col("do_key"), [F.col("sequence")], is_left, value), run, batch_id)

    follow(
        spark, store, handle, f"{root}-checkpoint", ALL_FILES_NOW, commits_per_batch=2
    ).awaitTermination()
    return kept.pairs().select(
        F.col("key").alias("order_number"),
        _cents("left.amount"),
        F.col("left.approved").alias("approved"),
        "right.description",
    )


def _clicks_in_batches(spark: SparkSession, folder: str) -> Pairing:
    """User events stored in four batches, in the order of time, and paired as they are followed."""

    def pairing_at(root: str) -> Pairing:
        return Pairing(spark, f"{root}-pairs", T.LongType(), T.LongType())

    def fill(root: str) -> None:
        rows = tables.table(spark, folder, "events")
        seconds = F.unix_micros(F.col("ts").cast("timestamp"))
        cuts = rows.agg(F.percentile_approx(seconds, [0.25, 0.5, 0.75])).first()[0] or []
        quarter = F.lit(0)
        for cut in cuts:
            quarter = quarter + (seconds > cut).cast("int")
        for batch in range(len(cuts) + 1):
            batches.append(rows.filter(quarter == batch), root, "user_events", "load", batch)

        def handle(new: DataFrame, run: str, batch_id: int) -> None:
            pairing_at(root).handle(pairing_rows(**_clicks(new)), run, batch_id)

        follow(
            spark, root, handle, f"{root}-checkpoint", ALL_FILES_NOW, "user_events", rows.schema, 1
        ).awaitTermination()

    return pairing_at(_once(spark, folder, "clicks", fill))


def stream_pair_clicks_purchases(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(_clicks_in_batches(spark, folder).pairs())


def stream_pending_clicks_purchases(spark: SparkSession, folder: str) -> DataFrame:
    waiting = _clicks_in_batches(spark, folder).open_rows()
    left, right = F.when(F.col("is_left"), F.col("value")), F.when(~F.col("is_left"), F.col("value"))
    return waiting.select("key", left.alias("left_id"), right.alias("right_id"))


# The copy of the store that is bucketed by order


def _by_order(spark: SparkSession, folder: str) -> DataFrame:
    """Stored events as the bucketed copy has them."""

    def name(root: str) -> str:
        return f"by_order_{root.rsplit('-', 1)[-1]}"

    def fill(root: str) -> None:
        _append_copy(spark, folder, _stored(spark, folder), root, 0)
        bucket_by_order(spark, name(root), root)

    root = _once(spark, folder, "by-order", fill)
    return read_by_order(spark, name(root), root)


def combo_by_order(spark: SparkSession, folder: str) -> DataFrame:
    """``combo_credit_reserve`` without a shuffle."""
    stored = _by_order(spark, folder)
    sides = [stages.side_of(events.event_feed(stored, name).select(*EVENT_COLUMNS), name) for name in (CREDIT, RESERVE)]
    return _credit_reserve_columns(pairing.pair(*sides))


def order_view_by_order(spark: SparkSession, folder: str) -> DataFrame:
    """The fold without a shuffle."""
    return _view_columns(view.order_view(_by_order(spark, folder)))


# Timers and metrics of their own streams


def _timers(spark: SparkSession, folder: str) -> Timers:
    """Two thirds of the starts, then all stops, then the other starts, followed batch by batch."""
    starts, stops = tables.api_starts(spark, folder), tables.api_stops(spark, folder)
    unknown = F.lit(None).cast("bigint")
    kind = starts.schema["id"].dataType

    def fill(root: str) -> None:
        late = F.col("id") % 3 == 0
        arriving = (
            starts.filter(~late).withColumn("stop_ms", unknown),
            stops.select("id", unknown.alias("start_ms"), "stop_ms"),
            starts.filter(late).withColumn("stop_ms", unknown),
        )
        for batch, rows in enumerate(arriving):
            batches.append(rows, root, "timers", "load", batch)
        follow(
            spark, root, Timers(spark, f"{root}-open", kind).handle, f"{root}-checkpoint", ALL_FILES_NOW, "timers",
            arriving[1].schema, 1,
        ).awaitTermination()

    return Timers(spark, f"{_once(spark, folder, 'timers', fill)}-open", kind)


def stream_timers(spark: SparkSession, folder: str) -> DataFrame:
    return _timers(spark, folder).counters()


def stream_in_flight(spark: SparkSession, folder: str) -> DataFrame:
    return _timers(spark, folder).in_flight()


def stream_idle_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Two snapshots, a step of the clock apart, of timers to which nothing comes."""
    timers, root = _timers(spark, folder), new_folder(spark, "snapshots")
    for _ in range(2):
        ticks = given_clock(spark, METRIC_EPOCH_MS, SNAPSHOT_STEP_MS)
        run_snapshots(ticks, timers.counters, root, f"{root}-checkpoint", ALL_FILES_NOW).awaitTermination()
    return snapshots(spark, root)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        order_lifecycle,
        order_requests,
        create_order_events,
        create_order_responses,
        price_lookup_events,
        enriched_price_events,
        credit_check_events,
        reserve_inventory_events,
        combo_credit_reserve,
        price_requests,
        balance_requests,
        reserve_requests,
        payment_requests,
        pull_requests,
        payment_events,
        pull_inventory_events,
        combo_payment_pull,
        ship_order_events,
        shippable_orders,
        order_rejects,
        pending_pairs,
        order_view,
        order_view_as_of,
        order_view_direct,
        view_rejects,
        order_descriptions,
        event_feed_by_type,
        subscribe_order_created,
        event_descriptions,
        event_roundtrip,
        event_store_counts,
        stage_metrics,
        sql_event_history,
        api_counters,
        metric_lines,
        latest_event_per_key,
        unknown_events,
        pair_clicks_purchases,
        pending_clicks_purchases,
        retained_events,
        last_events,
        sql_events_after_rework,
        stream_after_rework,
        stream_subscribe_order_created,
        stream_numbered_events,
        stream_numbered_view,
        stream_order_events,
        stream_two_runs,
        stream_repeated_requests,
        stream_api_counters,
        stream_order_view,
        stream_combo_credit_reserve,
        stream_pair_clicks_purchases,
        stream_pending_clicks_purchases,
        combo_by_order,
        order_view_by_order,
        stream_timers,
        stream_in_flight,
        stream_idle_snapshots,
    )
}
HYDRATED = {
    "hydrate_create_order": CREATE,
    "hydrate_price_lookup": PRICE,
    "hydrate_credit_check": CREDIT,
    "hydrate_reserve_inventory": RESERVE,
    "hydrate_collect_payment": PAYMENT,
    "hydrate_pull_inventory": PULL,
    "hydrate_ship_order": SHIP,
}
QUERIES.update({key: _hydrate(name) for key, name in HYDRATED.items()})
