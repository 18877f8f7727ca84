"""Order lifecycle over a request stream, one micro-batch at a time, each stored exactly once."""

from __future__ import annotations

import time
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderloom.operators.counters import STAGE_METRICS, counter_row, metric_lines
from orderloom.operators.events import create_order_responses
from orderloom.plans.lifecycle import Lookups, all_events, all_rejects, order_facts
from orderloom.schemas import CREATE, EVENT_COLUMNS, EVENT_TYPES, REJECT, REQUEST
from orderloom.sinks import batches
from orderloom.sinks.tables import EVENTS, MIXED_FROM, clustered
from orderloom.streaming.runs import start

# Tables below the root of a deployment, beside the events.
ACCEPTED, REJECTS, RESPONSES = "accepted", "rejects", "responses"
JOB_METRICS, COUNTS, METRICS = "job_metrics", "api_counts", "metrics"
RESPONSE = "request_id string, order_number string, correlation_id string"
JOB_METRIC = "metric string, n bigint"
# Milliseconds of tens of millions of old requests add up to more than a long holds.
COUNT = "IN bigint, OK bigint, ELAPSED decimal(38,0)"
METRIC = "epoch_ms bigint, name string, value string, line string"

DIFFERS = "differs from the request accepted under its id"
_PAYLOAD = [c for c in REQUEST.fieldNames() if c not in ("request_id", "arrived_ms")]


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def now_ms() -> int:
    return int(time.time() * 1000)


def accept(deliveries: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests to handle, and rejects for deliveries that differ from the one that counts.

    The rule is the same within and across batches: the first accepted request of an id stands. In
    one batch that is the one that arrived first, and of those the smallest. An equal delivery is a
    repeat and leaves no trace; one without id counts each time and is rejected by the chain.
    ``known`` are the requests accepted before; only those with an id of this batch are kept.
    """
    has_id = F.col("request_id").isNotNull()
    # Payloads that differ are few, so the ids of a batch come together as one row each.
    distinct = deliveries.filter(has_id).groupBy("request_id", *_PAYLOAD).agg(F.min("arrived_ms").alias("arrived_ms"))
    order = F.struct(F.coalesce("arrived_ms", F.lit(2**63 - 1)).alias("at"), *_PAYLOAD, "arrived_ms")
    first = distinct.groupBy("request_id").agg(F.min(order).alias("first"))
    old = known.join(first.select("request_id"), "request_id", "left_semi")
    old = old.select("request_id", F.struct(*_PAYLOAD).alias("old"))
    judged = first.join(old, "request_id", "left")
    new = judged.filter(F.col("old").isNull()).select("request_id", *[f"first.{c}" for c in _PAYLOAD], "first.arrived_ms")
    standing = judged.select("request_id", F.coalesce("old", F.struct(*[f"first.{c}" for c in _PAYLOAD])).alias("stands"))
    odd = distinct.join(standing, "request_id").filter(~F.struct(*_PAYLOAD).eqNullSafe(F.col("stands")))
    rejects = odd.select(
        F.col("request_id").alias("do_key"),
        F.lit(EVENT_TYPES[CREATE].short_name).alias("stage"),
        F.lit(DIFFERS).alias("reason"),
    )
    return new.select(*REQUEST.fieldNames()).unionByName(deliveries.filter(~has_id)), rejects


def process_batch(
    deliveries: DataFrame,
    root: str,
    run: str,
    batch_id: int,
    lookups: Lookups,
    require_success: bool = False,
    clock: Callable[[], int] = now_ms,
) -> bool:
    """Runs all steps on one batch of deliveries and commits all its tables together.

    A batch that its run has committed before is left as it is. IN counts deliveries, OK the orders
    made, and ELAPSED adds up the time of each from its request's arrival to the end of the batch. A batch that
    may make ``MIXED_FROM`` events is stored mixed, by order, and without a shuffle by type.
    """
    spark = deliveries.sparkSession
    if batches.is_committed(spark, root, run, batch_id):
        return False
    deliveries = deliveries.select(*REQUEST.fieldNames())
    # Deliveries are not written, only shuffled, where a task that runs again would count twice.
    delivered = deliveries.count()
    batch = batches.Batch(spark, root, run, batch_id, mixed=delivered * len(EVENT_TYPES) >= MIXED_FROM)
    known = batches.read(spark, root, ACCEPTED, REQUEST)
    requests, differing = accept(deliveries, known)
    facts = order_facts(requests, lookups, require_success)
    facts = (facts.sortWithinPartitions("do_key") if batch.mixed else facts).persist()
    # Counted by the tasks that write, so no pass is made for them, and one that runs again counts once.
    of_type = {metric: F.count_if(F.col("event_name") == event) for metric, event in STAGE_METRICS.items()}
    arrived = F.sum(F.col("arrived_ms").cast("decimal(20,0)"))
    arrivals = {"timed": F.count("arrived_ms"), "arrived": F.coalesce(arrived, F.lit(0))}
    try:
        events = all_events(facts).select(*EVENT_COLUMNS)
        handled = batch.write(events if batch.mixed else clustered(events), EVENTS, "event_name", watch=of_type)
        batch.write(all_rejects(facts).unionByName(differing).select(*REJECT.fieldNames()), REJECTS)
        accepted = facts.filter("created").select(
            "request_id", "account_number", "item_number", "location", "quantity", F.col("event_time").alias("arrived_ms")
        )
        batch.write(create_order_responses(accepted), RESPONSES)
        seen = batch.write(accepted, ACCEPTED, watch=arrivals)
    finally:
        facts.unpersist()
    batch.write(spark.createDataFrame(list(handled.items()), JOB_METRIC).coalesce(1), JOB_METRICS)
    orders, stop = batch.sizes[ACCEPTED], clock()
    elapsed = Decimal(seen["timed"] * stop - int(seen["arrived"]))
    row = spark.createDataFrame([(delivered, orders, elapsed)], COUNT).coalesce(1)
    batch.write(row, COUNTS)
    totals = counter_row(_totals(spark, root, row))
    snapshot = metric_lines(totals, stop).select(F.lit(stop).cast("bigint").alias("epoch_ms"), "name", "value", "line")
    batch.write(snapshot.coalesce(1), METRICS)
    batch.commit()
    return True


def run_orders(
    requests: DataFrame,
    root: str,
    lookups: Callable[[], Lookups],
    checkpoint: str,
    trigger: dict | None = None,
    require_success: bool = False,
    clock: Callable[[], int] = now_ms,
) -> StreamingQuery:
    """Starts the stream. ``lookups`` is called for every batch, so it can be current.

    Pass lookups whose keys are checked already (``saved_lookups``): a batch then joins each table
    once and scans none to check it.
    """
    return start(
        requests,
        lambda rows, run, n: process_batch(rows, root, run, n, lookups(), require_success, clock),
        checkpoint,
        trigger,
    )


def compact_orders(spark: SparkSession, root: str) -> None:
    """Puts the small files of many batches together; readers and streams go on as before."""
    for table, schema in ((ACCEPTED, REQUEST), (REJECTS, REJECT), (RESPONSES, _schema(RESPONSE))):
        batches.compact(spark, root, table, schema)
    batches.compact(spark, root, COUNTS, _schema(COUNT), lambda rows: rows.agg(*_sums()))


def _sums() -> list:
    return [F.coalesce(F.sum(f.name), F.lit(0)).cast(f.dataType).alias(f.name) for f in _schema(COUNT)]


def _totals(spark: SparkSession, root: str, more: DataFrame | None = None) -> DataFrame:
    rows = batches.read(spark, root, COUNTS, _schema(COUNT))
    rows = rows if more is None else rows.unionByName(more)
    return rows.agg(*_sums())


def counters(spark: SparkSession, root: str) -> DataFrame:
    """API counters over all batches, whatever retention did to the events.

    ELAPSED is a long, or a ``decimal(38,0)`` once the total has outgrown it.
    """
    totals = _totals(spark, root)
    row = counter_row(totals)
    return row.withColumn("ELAPSED", F.col("ELAPSED").cast("bigint")) if _fits(totals) else row


def _fits(totals: DataFrame) -> bool:
    """Whether the elapsed time of all orders is a long."""
    return -(2**63) <= int(totals.first()["ELAPSED"]) < 2**63


def rejects(spark: SparkSession, root: str) -> DataFrame:
    return batches.read(spark, root, REJECTS, REJECT)


def responses(spark: SparkSession, root: str) -> DataFrame:
    return batches.read(spark, root, RESPONSES, _schema(RESPONSE))


def job_metrics(spark: SparkSession, root: str) -> DataFrame:
    rows = batches.read(spark, root, JOB_METRICS, _schema(JOB_METRIC))
    return rows.groupBy("metric").agg(F.sum("n").alias("n"))


def metric_series(spark: SparkSession, root: str) -> DataFrame:
    """The snapshots of all batches, each with its time."""
    return batches.read(spark, root, METRICS, _schema(METRIC))
