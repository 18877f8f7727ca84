"""Requests, lookups and timers derived from the order tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators.lookup import most_copies
from orderloom.plans.lifecycle import LOOKUP_TABLES, Lookups
from orderloom.sinks import batches

# Bounds of order numbers, the upper one left out; the last span has no upper one.
Span = tuple[int | None, int | None]

# Columns used here; a given schema spares the scan of every file's footer.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
        "l_shipdate timestamp_ntz"
    ),
    "part": "p_partkey bigint, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _labelled(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def order_spans(spark: SparkSession, folder: str, parts: int) -> list[Span]:
    """Deals the orders by their numbers to parts of about as many line items."""
    shares = [k / parts for k in range(1, parts)]
    cuts = table(spark, folder, "lineitem").agg(F.percentile_approx("l_orderkey", shares)).first()[0]
    ends = [None, *(cuts or []), None]
    return list(zip(ends, ends[1:]))


def _within(rows: DataFrame, key: str, span: Span) -> DataFrame:
    """Rows of a span; those without a number are in the last one."""
    low, high = span
    number, within = F.col(key), F.lit(True)
    if low is not None:
        within = number >= low
    if high is not None:
        within &= number < high
    elif low is not None:
        within |= number.isNull()
    return rows.filter(within)


def requests(spark: SparkSession, folder: str, how: str = "inner", span: Span = (None, None)) -> DataFrame:
    """One order request per order, part and supplier, which arrives on the order's date.

    With ``how="right"`` an order without line items makes a request that names no item. Line items are
    summed before the join with orders, so an order with very many lines is combined on the map side and
    its requests spread over the shuffle by all three keys.

    With ``span`` only the requests of some orders are made; those of all of ``order_spans`` are all requests.
    """
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    lines, orders = _within(lines, "l_orderkey", span), _within(orders, "o_orderkey", span)
    lines = (
        lines.groupBy("l_orderkey", "l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").cast("int").alias("quantity"))
    )
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), how).select(
        F.concat_ws("-", "o_orderkey", "l_partkey", "l_suppkey").alias("request_id"),
        _labelled("A", "o_custkey").alias("account_number"),
        _labelled("I", "l_partkey").alias("item_number"),
        _labelled("L", "l_suppkey").alias("location"),
        "quantity",
        _epoch_ms(F.col("o_orderdate")).alias("arrived_ms"),
    )


def lookups(spark: SparkSession, folder: str) -> Lookups:
    """Prices, balances and stock; stock is unique by construction."""
    return Lookups(
        prices(spark, folder),
        balances(table(spark, folder, "customer")),
        stock(spark, folder),
        check=("prices", "balances"),
    )


def saved_lookups(full: Lookups, path: str) -> Lookups:
    """One version of the lookups, written and checked once, for a stream that joins them in
    every batch: the joins then need not look for repeated keys again."""
    read = {}
    for name in LOOKUP_TABLES:
        rows = getattr(full, name)
        rows.write.parquet(f"{path}/{name}")
        read[name] = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")
    return _checked(full, read)


@contextmanager
def lookups_by_item(full: Lookups, path: str) -> Iterator[Lookups]:
    """``saved_lookups`` for a load in parts, gone when it ends.

    Prices and stock are bucketed by item, so a part's requests are shuffled to the buckets, and the whole
    stock is not shuffled for each part. Writing and checking leave no shuffle files.
    """
    spark = full.prices.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = {}
    try:
        with batches.cleaned_up(spark):
            for name, (_, keys) in LOOKUP_TABLES.items():
                rows, saved = getattr(full, name), f"{name}_{uuid.uuid4().hex}"
                (
                    rows.repartition(buckets, keys[0])
                    .sortWithinPartitions(*keys)
                    .write.bucketBy(buckets, keys[0])
                    .sortBy(*keys)
                    .option("path", f"{path}/{name}")
                    .saveAsTable(saved, format="parquet")
                )
                read[name] = saved
            checked = _checked(full, {name: spark.table(saved) for name, saved in read.items()})
        yield checked
    finally:
        for saved in read.values():
            spark.sql(f"DROP TABLE {saved}")
        batches.delete(spark, path)


def _checked(full: Lookups, read: dict[str, DataFrame]) -> Lookups:
    """Lookups as they were saved, which need no check for repeated keys any more."""
    for name in full.check:
        _, keys = LOOKUP_TABLES[name]
        if most_copies(read[name], keys).first()["copies"] > 1:
            raise ValueError(f"lookup by {', '.join(keys)} has a repeated key")
    return full._replace(**read, check=())


def placed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as one side of a pairing."""
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey")


def shipped(spark: SparkSession, folder: str) -> DataFrame:
    """First shipment of each order that has line items, as the other side."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    return lines.agg(F.min("l_shipdate").alias("shipped"))


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        _labelled("I", "p_partkey").alias("item_number"),
        (F.col("p_retailprice").cast("decimal(10,2)") * 100).cast("bigint").alias("price_cents"),
    )


def balances(customers: DataFrame) -> DataFrame:
    return customers.select(
        _labelled("A", "c_custkey").alias("account_number"),
        F.col("c_acctbal").cast("bigint").alias("balance"),
    )


def stock(spark: SparkSession, folder: str) -> DataFrame:
    """Stock per part and supplier that ever shipped it."""
    kept = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    return kept.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        _labelled("I", "l_partkey").alias("item_number"),
        _labelled("L", "l_suppkey").alias("location"),
        F.col("p_size").alias("on_hand"),
    )


def _epoch_ms(moment: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(F.to_date(moment)) * F.lit(86_400_000).cast("bigint")
    clock = F.hour(moment) * 3_600_000 + F.minute(moment) * 60_000
    return day + clock + (F.extract(F.lit("SECOND"), moment) * 1000).cast("bigint")


def api_starts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), _epoch_ms(F.col("o_orderdate")).alias("start_ms")
    )


def api_stops(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    return first.agg(F.min("l_shipdate").alias("stopped")).select(
        "id", _epoch_ms(F.col("stopped")).alias("stop_ms")
    )
