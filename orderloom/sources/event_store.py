"""Reading the stored events: whole, by type, from a position, and batch by batch as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderloom.operators.events import event_feed
from orderloom.schemas import EVENT, EVENT_COLUMNS, STORED_EVENT
from orderloom.sinks import batches
from orderloom.sinks.tables import EVENTS
from orderloom.streaming.runs import start


def read_events(spark: SparkSession, root: str, after: int = 0) -> DataFrame:
    """All committed events, or those committed after a position; a filter on type prunes folders."""
    return batches.read(spark, root, EVENTS, STORED_EVENT, after=after)


def read_feed(spark: SparkSession, root: str, name: str) -> DataFrame:
    return event_feed(read_events(spark, root), name).select(*EVENT_COLUMNS)


def follow(
    spark: SparkSession,
    root: str,
    handle: Callable[[DataFrame, str, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    table: str = EVENTS,
    schema: T.StructType = EVENT,
    commits_per_batch: int = 1000,
    from_ms: int | None = None,
) -> StreamingQuery:
    """Stream of a stored table from the oldest batch that counts: ``handle(rows, run, batch_id)``.

    The stream follows the commit log, so it sees each batch once, whole, and lists no other folders.
    A batch that was compacted before the stream came to it is read from where its rows are then, one
    that retention has given up is left out, and compactions of batches that were seen add nothing. So
    a new follower gets what ``read_events`` gives, and then what is committed later; replaced files may
    be gone. A table that was compacted has to keep the origin of its rows.

    With ``from_ms`` the stream starts at that event time: batches that end before it are not read,
    events before it, or without a time, are left out.
    """
    batches.open_store(spark, root)
    log = (
        spark.readStream.schema(batches.COMMIT)
        .option("maxFilesPerTrigger", commits_per_batch)
        .parquet(f"{root}/commits")
    )

    def each(commits: DataFrame, run: str, batch_id: int) -> None:
        own = F.array_contains("tables", table) & (F.size("replaces") == 0)
        if from_ms is not None:
            own &= F.element_at("latest", table) >= from_ms
        new = commits.filter(own).orderBy("position", "run").select("attempt").collect()
        rows = batches.read_origins(spark, root, table, schema, [r["attempt"] for r in new])
        handle(rows if from_ms is None else rows.filter(F.col("event_time") >= from_ms), run, batch_id)

    return start(log, each, checkpoint, trigger)
