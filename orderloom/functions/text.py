"""Text forms of events, orders and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.schemas import CREATE, PAYMENT, PRICE, PULL, RESERVE

# Line formats per event type, with the columns that fill them.
EVENT_FORMATS = {
    CREATE: (
        "CreateOrderEvent for order %s I:%s L:%s A:%s Q:%s",
        ("do_key", "item_number", "location", "account_number", "quantity"),
    ),
    PRICE: ("PriceLookupEvent for order %s extended price %s", ("do_key", "amount")),
    RESERVE: ("ReserveInventoryEvent I:%s Q:%s", ("item_number", "quantity")),
    PAYMENT: ("CollectPaymentEvent for order %s amount charged %s", ("do_key", "amount")),
    PULL: ("PullInventoryEvent I:%s Q:%s", ("item_number", "quantity")),
}
ORDER_FORMAT = "Order %s I:%s L:%s A:%s Q:%s"
METRIC_FORMAT = "%s %s %s \n"
METRIC_PREFIX = "order.create."


def fill(pattern: str, *values: Column) -> Column:
    """The pattern with each ``%s`` replaced; a missing value reads ``null``.

    ``format_string`` would do the same through a Java formatter per row, several times slower.
    """
    first, *rest = pattern.split("%s")
    parts = [F.lit(first)]
    for value, text in zip(values, rest, strict=True):
        parts += [F.coalesce(value.cast("string"), F.lit("null")), F.lit(text)]
    return F.concat(*parts)


def event_line(event_name: Column) -> Column:
    """Line for an event row; null for the two types that have no text form."""
    line = F.lit(None).cast("string")
    for name, (pattern, columns) in EVENT_FORMATS.items():
        text = fill(pattern, *[F.col(c) for c in columns])
        line = F.when(event_name == name, text).otherwise(line)
    return line


def order_line() -> Column:
    """Line for a row of the order view."""
    columns = ("order_number", "item_number", "location", "account_number", "quantity")
    return fill(ORDER_FORMAT, *[F.col(c) for c in columns])


def epoch_seconds(epoch_ms: Column) -> Column:
    return F.call_function("div", epoch_ms, F.lit(1000))


def metric_name(name: Column, prefix: str = METRIC_PREFIX) -> Column:
    return F.concat(F.lit(prefix), name)


def metric_line(name: Column, value: Column, epoch_ms: Column) -> Column:
    """``<name> <value> <epoch seconds> `` and a line break; ``value`` is already text."""
    return fill(METRIC_FORMAT, name, value, epoch_seconds(epoch_ms))
