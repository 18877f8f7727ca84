"""Starting streams whose batches know which run they belong to."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

EVERY = {"processingTime": "5 seconds"}


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, str, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Calls ``handle(rows, run, batch_id)`` for every micro-batch.

    The run is the id that Spark keeps in the checkpoint: a restart goes on with the same run, and a
    stream with another checkpoint is another run, so its batches are never taken for this one's.
    """
    run: list[str] = []
    known = threading.Event()

    def each(rows: DataFrame, batch_id: int) -> None:
        known.wait()
        handle(rows, run[0], batch_id)

    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY))
        .start()
    )
    run.append(str(query.id))
    known.set()
    return query
