"""Order requests as a table, as a stream, or as literal rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from orderloom.schemas import EVENT, REQUEST


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(REQUEST).format(fmt).load(path)


def stream_requests(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Request stream over a folder that files arrive in; bounds the files of one batch."""
    return (
        spark.readStream.schema(REQUEST)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def literal_events(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """A bounded source of constant events; columns left out are null."""
    full = [tuple(row.get(name) for name in EVENT.fieldNames()) for row in rows]
    return spark.createDataFrame(full, EVENT)
