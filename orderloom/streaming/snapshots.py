"""Metric snapshots by the clock, whether or not anything arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderloom.operators.counters import metric_lines
from orderloom.sinks import batches
from orderloom.streaming.runs import EVERY, start

SNAPSHOTS = "snapshots"
_SCHEMA = T.StructType(
    [T.StructField("epoch_ms", T.LongType()), *[T.StructField(name, T.StringType()) for name in ("name", "value", "line")]]
)


def seconds(spark: SparkSession) -> DataFrame:
    """A row with the time for every second that passes."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load()


def given_clock(spark: SparkSession, start_ms: int, step_ms: int) -> DataFrame:
    """The same from a clock that goes on by ``step_ms`` with each batch."""
    options = {"rowsPerBatch": 1, "startTimestamp": start_ms, "advanceMillisPerBatch": step_ms}
    return spark.readStream.format("rate-micro-batch").options(**options).load()


def run_snapshots(
    ticks: DataFrame,
    totals: Callable[[], DataFrame],
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts a stream of its own that keeps the counters of ``totals()`` at each trigger.

    ``ticks`` has a ``timestamp``; the last one of a trigger is the time of its snapshot. Triggers that
    were missed give one snapshot, as the totals in between are not known any more.
    """

    def each(rows: DataFrame, run: str, batch_id: int) -> None:
        at = rows.agg(F.max(F.unix_millis("timestamp"))).first()[0]
        if at is not None:
            lines = metric_lines(totals(), at).withColumn("epoch_ms", F.lit(at).cast("bigint"))
            batches.append(lines.select(*_SCHEMA.fieldNames()).coalesce(1), root, SNAPSHOTS, run, batch_id)

    return start(ticks, each, checkpoint, trigger or EVERY)


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """``(epoch_ms, name, value, line)`` of all snapshots."""
    return batches.read(spark, root, SNAPSHOTS, _SCHEMA)
