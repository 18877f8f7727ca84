"""API counters, latency, and their metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.text import METRIC_PREFIX, metric_line, metric_name
from orderloom.schemas import CREATE, PRICE, RESERVE

# Metric names and the event type each one counts.
STAGE_METRICS = {
    "COP.completions": CREATE,
    "PLP.completions": PRICE,
    "RIP.handleEventCalled": RESERVE,
    "RIP.completions": RESERVE,
}


def api_counters(starts: DataFrame, stops: DataFrame) -> DataFrame:
    """One row of counters from ``(id, start_ms)`` and ``(id, stop_ms)``, ids unique.

    A stop without a start counts as completed but adds no elapsed time.
    """
    timers = starts.select("id", "start_ms", F.lit(1).alias("started")).join(
        stops.select("id", "stop_ms", F.lit(1).alias("stopped")), "id", "full_outer"
    )
    return counter_row(
        timers.agg(
            F.count("started").alias("IN"),
            F.count("stopped").alias("OK"),
            F.coalesce(F.sum(F.col("stop_ms") - F.col("start_ms")), F.lit(0)).alias("ELAPSED"),
        )
    )


def counter_row(totals: DataFrame) -> DataFrame:
    """Full counter row from IN, OK and ELAPSED; failures are reported but never counted."""
    ok = F.col("OK")
    return totals.select(
        "IN",
        "OK",
        F.lit(0).cast("bigint").alias("FAIL"),
        ok.alias("COMPLETE"),
        "ELAPSED",
        F.when(ok != 0, F.col("ELAPSED").cast("double") / ok.cast("double")).alias("LATENCY_OK"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Events per type."""
    return events.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))


def stage_metrics(events: DataFrame) -> DataFrame:
    """Value of every job metric, zero for a job that has handled nothing."""
    totals = events.agg(
        *[
            F.count_if(F.col("event_name") == event).alias(metric)
            for metric, event in STAGE_METRICS.items()
        ]
    )
    return totals.unpivot(
        [], [F.col(f"`{m}`") for m in STAGE_METRICS], "metric", "n"
    )


def metric_rows(counters: DataFrame, prefix: str = METRIC_PREFIX) -> DataFrame:
    """``(name, value)`` per reported counter; the value is text, as it is printed."""
    names = ("IN", "OK", "FAIL", "COMPLETE", "LATENCY_OK")
    values = [
        F.struct(
            metric_name(F.lit(n), prefix).alias("name"), F.col(n).cast("string").alias("value")
        )
        for n in names
    ]
    return counters.select(F.inline(F.array(*values)))


def metric_lines(counters: DataFrame, epoch_ms: int, prefix: str = METRIC_PREFIX) -> DataFrame:
    """The same rows with the text line a metrics collector reads."""
    rows = metric_rows(counters, prefix)
    line = metric_line(F.col("name"), F.col("value"), F.lit(epoch_ms))
    return rows.withColumn("line", line)
