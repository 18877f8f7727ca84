"""Event append, keyed upsert, retention, text lines and discard, on tables kept by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.view import latest_per_key
from orderloom.schemas import EVENT, EVENT_COLUMNS
from orderloom.sinks import batches

EVENTS = "events"

# Events of a batch from which numbered events and order streams are stored mixed: those of half a million orders.
MIXED_FROM = 7 << 19


def append_events(
    events: DataFrame,
    root: str,
    run: str = "load",
    batch_id: int = 0,
    gather: bool = True,
    mixed: bool = False,
    into: str | None = None,
) -> bool:
    """Adds one batch of events, in a folder per event type; False if it is there already.

    ``gather=False`` spares the shuffle that makes few files of a batch, whatever its size: each task writes
    a file for each type it has. For large batches whose tasks are large, such as a whole load or a copy.

    ``mixed=True`` keeps the types together, in the order in which the events come, and spares that shuffle too.
    Where an order's events follow each other, what they share is stored about once and not with every event. For
    loads whose size on disk matters more than that a feed of one type reads all of them. ``into`` names a table
    over the mixed batches to write through.
    """
    rows = events.select(*EVENT_COLUMNS)
    rows = clustered(rows) if gather and not mixed else rows
    return batches.append(rows, root, EVENTS, run, batch_id, "event_name", mixed=mixed, into=into)


def clustered(events: DataFrame) -> DataFrame:
    """Events of a type together in few files, whatever the number of tasks that made them.

    The exchange is split where a type is large, so no type waits for one task.
    """
    return events.hint("rebalance", "event_name")


def compact_events(spark: SparkSession, root: str) -> None:
    batches.compact(spark, root, EVENTS, EVENT, clustered, ("event_name",), keep_origin=True)


def drop_events_up_to(spark: SparkSession, root: str, position: int) -> None:
    """Retention of events only: accepted requests, counters and metrics keep all batches."""
    batches.retain(spark, root, EVENTS, position)


def keep_last_events(spark: SparkSession, root: str, n: int) -> None:
    """Retention by number: the last ``n`` events stay, and the rest of the batch that holds the first of them."""
    drop_events_up_to(spark, root, batches.position_before_last(spark, root, EVENTS, n))


def upsert(rows: DataFrame, root: str, run: str, batch_id: int, table: str = "latest") -> bool:
    """Adds new values for keys; ``read_upserts`` gives the last one of each."""
    return batches.append(rows, root, table, run, batch_id)


def read_upserts(
    spark: SparkSession, root: str, schema: T.StructType, key: str, table: str = "latest"
) -> DataFrame:
    """Last written row of each key, in the given schema.

    Reads what was written since the last ``compact_upserts`` and that snapshot.
    """
    return newest(_ranked(spark, root, schema, table), schema, key)


def compact_upserts(
    spark: SparkSession, root: str, schema: T.StructType, key: str, table: str = "latest"
) -> None:
    """Replaces all batches by one with the last row of each key."""
    batches.compact(
        spark, root, table, schema, lambda _: read_upserts(spark, root, schema, key, table)
    )


def _ranked(spark: SparkSession, root: str, schema: T.StructType, table: str) -> DataFrame:
    """Rows with the position of the batch that wrote them."""
    marked = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    places = [(k, attempt) for k, (_, attempt) in enumerate(batches.attempts(spark, root, table))]
    rows = batches.read(spark, root, table, marked, [attempt for _, attempt in places])
    order = spark.createDataFrame(places, "position bigint, attempt string")
    return rows.join(F.broadcast(order), "attempt").drop("attempt")


def newest(rows: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    return latest_per_key(rows, key, "position").select(*schema.fieldNames())


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Text file sink, one row per line; a line's own closing break is not doubled.

    The folder is a new one: what an earlier run wrote is never replaced.
    """
    text = F.regexp_replace(F.col(column), "\n$", "").alias("value")
    lines.select(text).write.mode("errorifexists").text(path)


def discard(rows: DataFrame) -> None:
    """Runs the plan and drops the rows."""
    rows.write.format("noop").mode("overwrite").save()
