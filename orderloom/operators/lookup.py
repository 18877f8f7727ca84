"""Lookup joins against the price, balance and stock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_copies(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how often the most repeated key occurs. Reads only the key columns."""
    rows = lookup
    for key in keys:  # a null key matches nothing
        rows = rows.filter(F.col(key).isNotNull())
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(F.coalesce(F.max("copies"), F.lit(0)).alias("copies"))


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], hit: str, check: bool = True
) -> DataFrame:
    """Left join on ``keys``; boolean column ``hit`` tells whether the key was found.

    A repeated lookup key would multiply rows, so with ``check`` the job fails on one. The
    check is a scalar subquery beside the join, not an aggregation below it: the join then
    stays directly over its two shuffles, which is the shape adaptive execution needs to split
    the partition of a hot key on the ``rows`` side.

    There is no broadcast hint. Spark broadcasts the lookup when its size is under the
    session's threshold and sort-merges otherwise.
    """
    found = F.lit(True)
    if check:
        message = F.lit(f"lookup by {', '.join(keys)} has a repeated key")
        once = most_copies(lookup, keys).scalar() <= 1
        found = F.when(once, found).otherwise(F.raise_error(message).cast("boolean"))
    return rows.join(lookup.withColumn(hit, found), keys, "left").withColumn(
        hit, F.col(hit).isNotNull()
    )
