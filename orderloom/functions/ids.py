"""Identifiers that stay the same when a task or a batch is run again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_number(request_id: Column) -> Column:
    """The request id names the order, so a retried batch numbers it the same way."""
    return request_id.cast("string")


def correlation_id(do_key: Column, event_name: Column) -> Column:
    """Stable id of one event's handling, in place of a random one."""
    return F.sha2(F.concat_ws("|", do_key, event_name), 256)
