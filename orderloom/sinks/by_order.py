"""Stored events bucketed by order, as the batches are written or as a copy: reads by order need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.schemas import EVENT_COLUMNS, STORED_EVENT
from orderloom.sinks import batches
from orderloom.sinks.tables import EVENTS, append_events

BY_ORDER = "by_order"
KEY = "do_key"
_HELD = "attempt string"


def order_table(spark: SparkSession, name: str, root: str, buckets: int) -> None:
    """Makes ``name`` a table over the mixed batches that ``append_by_order`` adds to the store."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORED_EVENT.fields)
    options = ", ".join(f"'{option}' '{value}'" for option, value in batches.MIXED_FORMAT.items())
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS ({options}) PARTITIONED BY (attempt) "
        f"CLUSTERED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{root}/{EVENTS}'"
    )


def append_by_order(events: DataFrame, root: str, name: str, run: str = "load", batch_id: int = 0) -> bool:
    """Adds a batch to the store through a table of ``order_table``, mixed; False if it is there already.

    Take events that are spread by order into as many partitions as the table has buckets, as ``repartition``
    does: each task then writes one file. Without that it writes one for each bucket it has.
    """
    return append_events(events, root, run, batch_id, gather=False, mixed=True, into=name)


def read_orders(spark: SparkSession, name: str, root: str) -> DataFrame:
    """What ``read_events`` gives, of a store that ``append_by_order`` writes.

    Joins and folds by order then have no shuffle, until other batches or compactions come to the store.
    """
    held = {r["attempt"] for r in spark.sql(f"SHOW PARTITIONS {name}").select(F.substring_index("partition", "=", -1).alias("attempt")).collect()}
    live = [attempt for _, attempt in batches.attempts(spark, root, EVENTS)]
    own, others = [a for a in live if a in held], [a for a in live if a not in held]
    rows = spark.table(name).filter(F.col("attempt").isin(own)).select(*STORED_EVENT.fieldNames())
    return rows.unionByName(batches.read(spark, root, EVENTS, STORED_EVENT, others)) if others else rows


def bucket_by_order(spark: SparkSession, name: str, root: str, buckets: int | None = None) -> None:
    """Makes ``name`` a table of the events that count now: a folder per type, bucketed and sorted by order.

    One shuffle by order writes one file for each type and bucket. Feeds of one type joined by order, and
    folds of an order, then read without another. ``name`` is a view that turns to the new copy in one
    step; earlier copies stay until someone deletes ``<root>/by_order/<version>``. Take as many buckets (by
    default one for each shuffle partition) as keep a bucket of all types within an executor's memory.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = [attempt for _, attempt in batches.attempts(spark, root, EVENTS)]
    version = uuid.uuid4().hex
    path, files = f"{root}/{BY_ORDER}/{version}", f"{name}_{version}"
    rows = batches.read(spark, root, EVENTS, STORED_EVENT, held).select(*EVENT_COLUMNS)
    spark.createDataFrame([(a,) for a in held], _HELD).coalesce(1).write.parquet(f"{path}/held")
    (
        rows.repartition(buckets, KEY)
        .sortWithinPartitions("event_name", KEY)
        .write.format("parquet")
        .partitionBy("event_name")
        .bucketBy(buckets, KEY)
        .sortBy(KEY)
        .option("path", f"{path}/events")
        .saveAsTable(files)
    )
    spark.sql(
        f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('path' = '{path}') "
        f"AS SELECT {', '.join(EVENT_COLUMNS)} FROM {files}"
    )


def read_by_order(spark: SparkSession, name: str, root: str) -> DataFrame:
    """What ``read_events`` gives, from the bucketed copy as far as it goes.

    Batches committed since are added from the store; where retention or compaction has replaced a batch
    that the copy holds, all comes from the store until ``bucket_by_order`` is called again. In both cases
    Spark shuffles as without a copy.
    """
    path = spark.sql(f"SHOW TBLPROPERTIES {name} ('path')").first()["value"]
    held = {r["attempt"] for r in spark.read.schema(_HELD).parquet(f"{path}/held").collect()}
    live = [attempt for _, attempt in batches.attempts(spark, root, EVENTS)]
    newer = live if held - set(live) else [attempt for attempt in live if attempt not in held]
    rest = batches.read(spark, root, EVENTS, STORED_EVENT, newer).select(*EVENT_COLUMNS)
    if held - set(live):
        return rest
    copy = spark.table(name)
    return copy.unionByName(rest) if newer else copy
