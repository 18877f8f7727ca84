"""Event rows: building them, reading them back by type, checking the round trip."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.ids import correlation_id, order_number
from orderloom.functions.text import event_line
from orderloom.schemas import CREATE, EVENT, EVENT_COLUMNS, EVENT_TYPES


def event_columns(
    name: str, do_key: Column, payload: Mapping[str, Column], event_time: Column
) -> list[Column]:
    """Columns of one event row in the shape all types share."""
    event_type = EVENT_TYPES[name]
    given = {
        "do_key": do_key,
        "sequence": F.lit(event_type.sequence),
        "event_name": F.lit(name),
        "event_time": event_time,
        **{field: payload[field] for field in event_type.fields},
    }
    return [
        given.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
        for field in EVENT.fields
    ]


def create_order_events(requests: DataFrame) -> DataFrame:
    """One Create event per request that has an id, which numbers the order."""
    payload = {f: F.col(f) for f in EVENT_TYPES[CREATE].fields}
    numbered = requests.filter(F.col("request_id").isNotNull())
    number = order_number(F.col("request_id"))
    return numbered.select(*event_columns(CREATE, number, payload, F.col("arrived_ms")))


def create_order_responses(requests: DataFrame) -> DataFrame:
    """What each caller gets back: its request id, the new order number, and the handling's id."""
    numbered = requests.filter(F.col("request_id").isNotNull())
    number = order_number(F.col("request_id"))
    return numbered.select(
        "request_id",
        number.alias("order_number"),
        correlation_id(number, F.lit(CREATE)).alias("correlation_id"),
    )


def event_feed(events: DataFrame, name: str) -> DataFrame:
    """Events of one type; on the stored table the filter prunes to that type's folders."""
    return events.filter(F.col("event_name") == name)


def subscribe_order_created(events: DataFrame, from_ms: int | None = None) -> DataFrame:
    """Notifications for Create events, from an offset in the feed on.

    The offset is an event time in epoch milliseconds, so it means the same whatever batches the
    events were stored in; events without a time precede every offset. On the stored table it is
    compared with the time ranges of the files before they are read. ``read_events(after=...)``
    leaves out whole batches that a subscriber has seen.
    """
    feed = event_feed(events, CREATE)
    if from_ms is not None:
        feed = feed.filter(F.col("event_time") >= from_ms)
    return feed.select(
        F.col("do_key").alias("order_number"),
        "account_number",
        "item_number",
        "location",
        "quantity",
    )


def hydrate(events: DataFrame, name: str, *keep: str) -> DataFrame:
    """Typed rows of one event type: its key columns and the fields it fills."""
    columns = ("do_key", "sequence", "event_time", *EVENT_TYPES[name].fields, *keep)
    return event_feed(events, name).select(*columns)


def dehydrate(typed: DataFrame, name: str, *keep: str) -> DataFrame:
    """Typed rows of one event type back in the shared shape."""
    payload = {f: F.col(f) for f in EVENT_TYPES[name].fields}
    return typed.select(*event_columns(name, F.col("do_key"), payload, F.col("event_time")), *keep)


def unknown_events(
    events: DataFrame, known: Iterable[str] = tuple(EVENT_TYPES), name: str = "event_name"
) -> DataFrame:
    """Events whose type nobody can decode, a missing name included."""
    column = F.col(name)
    return events.filter(column.isNull() | ~column.isin(*known))


def describe_events(events: DataFrame) -> DataFrame:
    """Order number, sequence and text line of the events that have a text form."""
    return events.select(
        F.col("do_key").alias("order_number"),
        "sequence",
        event_line(F.col("event_name")).alias("line"),
    ).filter(F.col("line").isNotNull())


def round_trip_mismatches(events: DataFrame) -> DataFrame:
    """Per type: rows read, and rows that differ after typed decoding and encoding.

    Both steps work row by row, so every row carries its original along and is compared with
    it in place; only the counts are shuffled.
    """
    row = F.struct(*EVENT_COLUMNS)
    carried = events.withColumn("original", row)
    back = [
        dehydrate(hydrate(carried, name, "original"), name, "original") for name in EVENT_TYPES
    ]
    same = row.eqNullSafe(F.col("original"))
    return (
        reduce(DataFrame.unionByName, back)
        .select(F.col("original.event_name").alias("event_name"), same.alias("same"))
        .groupBy("event_name")
        .agg(F.count(F.lit(1)).alias("n_in"), F.count_if(~F.col("same")).alias("n_mismatch"))
    )


def register_event_view(events: DataFrame, name: str = "order_events") -> None:
    """Exposes events to SQL under ``name`` for this session."""
    events.createOrReplaceTempView(name)
