"""Timers whose start and stop come in batches of their own, and the counters they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.counters import counter_row
from orderloom.sinks import batches
from orderloom.sinks.tables import read_upserts

OPEN, COUNTS = "open_timers", "timer_counts"
COMPACT_EVERY = 50
_COUNTERS = ("IN", "OK", "ELAPSED")


class Timers:
    """Open timers over batches that arrive in order, kept in a store of their own.

    A timer opens with whichever of its start and stop comes first, as the two may be feeds of their
    own, and closes with the other; then only its elapsed time is kept. IN counts starts, OK stops, with
    or without a start. Of several rows of one side that a timer gets before it closes the earliest of
    the first batch counts; a closed timer's id starts another timer. A batch reads the open timers of its own ids
    and writes one row for each; ``COMPACT_EVERY`` batches become one snapshot of the open timers.
    """

    def __init__(self, spark: SparkSession, root: str, id_type: T.DataType):
        self.spark, self.root = spark, root
        # A row without start and stop says that nothing is open.
        self.schema = T.StructType(
            [
                T.StructField("id", id_type),
                T.StructField("start_ms", T.LongType()),
                T.StructField("stop_ms", T.LongType()),
            ]
        )
        self.counts = T.StructType([T.StructField(name, T.LongType()) for name in _COUNTERS])

    def handle(self, rows: DataFrame, run: str, batch_id: int) -> bool:
        """Takes one batch of ``(id, start_ms, stop_ms)``, one of the times null where it is not known.

        False if the batch is committed already. Rows without id or without both times have no effect.
        """
        spark, root = self.spark, self.root
        if batches.is_committed(spark, root, run, batch_id):
            return False
        new = (
            rows.filter("id is not null and (start_ms is not null or stop_ms is not null)")
            .groupBy("id")
            .agg(F.min("start_ms").alias("new_start"), F.min("stop_ms").alias("new_stop"))
            .persist()
        )
        try:
            old = self.open_timers().join(new.select("id"), "id", "left_semi")
            start, stop = F.coalesce("start_ms", "new_start"), F.coalesce("stop_ms", "new_stop")
            closed = start.isNotNull() & stop.isNotNull()
            # Counted on what the writing tasks are given, so a task that runs again counts once.
            seen = Observation()
            now = new.join(old, "id", "left").observe(
                seen,
                F.count_if(F.col("start_ms").isNull() & F.col("new_start").isNotNull()).alias("IN"),
                F.count_if(F.col("stop_ms").isNull() & F.col("new_stop").isNotNull()).alias("OK"),
                F.coalesce(F.sum(F.when(closed, stop - start)), F.lit(0)).alias("ELAPSED"),
            )
            batch = batches.Batch(spark, root, run, batch_id)
            still = [F.when(~closed, time).alias(name) for name, time in (("start_ms", start), ("stop_ms", stop))]
            batch.write(now.select("id", *still), OPEN)
        finally:
            new.unpersist()
        counted = tuple(seen.get[name] for name in _COUNTERS)
        batch.write(spark.createDataFrame([counted], self.counts).coalesce(1), COUNTS)
        batch.commit()
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            self.compact()
        return True

    def open_timers(self) -> DataFrame:
        """``(id, start_ms, stop_ms)`` of the timers that wait for their stop, or for their start."""
        known = read_upserts(self.spark, self.root, self.schema, "id", OPEN)
        return known.filter("start_ms is not null or stop_ms is not null")

    def in_flight(self) -> DataFrame:
        """Timers that have started and not stopped."""
        return self.open_timers().filter("start_ms is not null").select("id", "start_ms")

    def compact(self) -> None:
        batches.compact(self.spark, self.root, OPEN, self.schema, lambda _: self.open_timers())
        batches.compact(self.spark, self.root, COUNTS, self.counts, lambda rows: rows.agg(*self._sums()))

    def counters(self) -> DataFrame:
        return counter_row(batches.read(self.spark, self.root, COUNTS, self.counts).agg(*self._sums()))

    def _sums(self) -> list:
        return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in _COUNTERS]
