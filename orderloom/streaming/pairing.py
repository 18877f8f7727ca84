"""Pairing of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.ordered_pairing import settle
from orderloom.sinks import batches
from orderloom.sinks.tables import newest

PAIRS, OPEN, UNUSABLE = "pairs", "open", "unusable"
COMPACT_EVERY = 50


def pair_streams(
    left: DataFrame, right: DataFrame, key: str, time: str, wait: str, how: str = "inner"
) -> DataFrame:
    """``(key, left, right)`` of two streams whose pairs lie within ``wait`` of each other.

    State older than that is dropped; ``how='full_outer'`` also gives the rows that found no
    partner, with the other side null. For pairs without a time bound use ``pair_batch``, whose
    state is the open rows alone.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withWatermark(time, wait)
        fields = [c for c in rows.columns if c != key]
        columns = [F.col(key).alias(f"{name}_key"), F.struct(*fields).alias(name)]
        return rows.select(*columns, F.col(time).alias(f"{name}_time"))

    bound = F.expr(f"INTERVAL {wait}")
    matches = (
        (F.col("left_key") == F.col("right_key"))
        & (F.col("left_time") >= F.col("right_time") - bound)
        & (F.col("left_time") <= F.col("right_time") + bound)
    )
    joined = side(left, "left").join(side(right, "right"), matches, how)
    return joined.select(F.coalesce("left_key", "right_key").alias(key), "left", "right")


class Pairing:
    """Repeated-key pairing over batches that arrive in order, kept in a store of its own.

    A row that finds no partner stays open, and is the first row its key has in the next batch; a
    pair clears it. A batch reads the open rows of its own keys, settles them with its new rows (a
    hot key is split over partitions), and writes the pairs, one change for each key it touched (an
    open row, or none), and the rows that have no key or side. Untouched keys are not rewritten.
    Changes are put together into a snapshot of the open rows every ``COMPACT_EVERY`` batches.
    """

    def __init__(self, spark: SparkSession, root: str, key: T.DataType, value: T.DataType):
        self.spark, self.root = spark, root
        self.pair_schema = T.StructType([T.StructField("key", key), T.StructField("left", value), T.StructField("right", value)])
        self.open_schema = T.StructType(
            [
                T.StructField("key", key),
                T.StructField("is_left", T.BooleanType()),  # null: nothing open
                T.StructField("value", value),
            ]
        )
        self.unusable_schema = T.StructType([*self.open_schema.fields, T.StructField("reason", T.StringType())])

    def handle(self, rows: DataFrame, run: str, batch_id: int) -> bool:
        """Settles one batch of ``(key, is_left, value, order)``; False if it is committed already."""
        spark, root = self.spark, self.root
        if batches.is_committed(spark, root, run, batch_id):
            return False
        batch = batches.Batch(spark, root, run, batch_id)
        later = F.struct(F.lit(1).alias("later"), F.col("order").alias("place"))
        rows = rows.select("key", "is_left", "value", later.alias("order")).persist()
        keys = rows.filter("key is not null and is_left is not null").select("key").distinct()
        place = rows.schema["order"].dataType["place"].dataType
        before = F.struct(F.lit(0).alias("later"), F.lit(None).cast(place).alias("place"))
        opened = self._changes().join(keys, "key", "left_semi")
        opened = newest(opened, self.open_schema, "key").filter("is_left is not null").withColumn("order", before)
        settled = settle(
            rows.unionByName(opened), F.col("key"), [F.col("order")], F.col("is_left"), F.col("value")
        )
        settled.inside.persist()
        try:
            batch.write(settled.pairs(), PAIRS)
            value = F.when(F.col("open_left"), F.col("left")).otherwise(F.col("right"))
            still = settled.open_rows().select("key", F.col("open_left").alias("is_left"), value.alias("value"))
            batch.write(keys.join(still, "key", "left"), OPEN)
            batch.write(settled.unusable, UNUSABLE)
        finally:
            settled.inside.unpersist()
            rows.unpersist()
        batch.commit()
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            self.compact()
        return True

    def _changes(self) -> DataFrame:
        marked = T.StructType([*self.open_schema.fields, T.StructField("attempt", T.StringType())])
        places = batches.attempts(self.spark, self.root, OPEN)
        rows = batches.read(self.spark, self.root, OPEN, marked, [attempt for _, attempt in places])
        order = self.spark.createDataFrame(places, "position bigint, attempt string")
        return rows.join(F.broadcast(order), "attempt").drop("attempt")

    def compact(self) -> None:
        batches.compact(self.spark, self.root, OPEN, self.open_schema, lambda _: self.open_rows())

    def pairs(self) -> DataFrame:
        return batches.read(self.spark, self.root, PAIRS, self.pair_schema)

    def open_rows(self) -> DataFrame:
        """``(key, is_left, value)`` of the keys that still wait for the other side."""
        return newest(self._changes(), self.open_schema, "key").filter("is_left is not null")

    def unusable(self) -> DataFrame:
        """Rows without key or side, with the reason."""
        return batches.read(self.spark, self.root, UNUSABLE, self.unusable_schema)


def pairing_rows(rows: DataFrame, key: Column, order_by: list[Column], is_left: Column, value: Column) -> DataFrame:
    """Rows in the shape that ``Pairing.handle`` takes."""
    return rows.select(key.alias("key"), is_left.alias("is_left"), value.alias("value"), F.struct(*order_by).alias("order"))
