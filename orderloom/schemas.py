"""Row shapes: requests, order events, the order view and the lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

UNIT_PRICE = T.DecimalType(10, 2)
AMOUNT = T.DecimalType(21, 2)  # decimal(10,2) * int

# Event names as they are stored, with their place in an order's chain.
CREATE = "CreateOrderEvent"
PRICE = "PriceLookupEvent"
CREDIT = "CreditCheckEvent"
RESERVE = "ReserveInventoryEvent"
PAYMENT = "CollectPaymentEvent"
PULL = "PullInventoryEvent"
SHIP = "ShipOrderEvent"


@dataclass(frozen=True)
class EventType:
    name: str
    sequence: int
    fields: tuple[str, ...]  # payload columns this type fills

    @property
    def short_name(self) -> str:
        return self.name.removesuffix("Event")


EVENT_TYPES: dict[str, EventType] = {
    t.name: t
    for t in (
        EventType(CREATE, 1, ("account_number", "item_number", "location", "quantity")),
        EventType(PRICE, 2, ("item_number", "location", "quantity", "amount")),
        EventType(CREDIT, 3, ("account_number", "amount", "approved")),
        EventType(
            RESERVE, 4, ("account_number", "item_number", "location", "quantity", "description")
        ),
        EventType(PAYMENT, 5, ("account_number", "amount")),
        EventType(PULL, 6, ("account_number", "item_number", "location", "quantity", "description")),
        EventType(SHIP, 7, ("item_number", "location", "quantity")),
    )
}

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("account_number", T.StringType()),
        T.StructField("item_number", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("arrived_ms", T.LongType()),  # epoch milliseconds
    ]
)

# One row of any event type; a type leaves the columns it does not use null.
EVENT = T.StructType(
    [
        T.StructField("do_key", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("event_time", T.LongType()),  # epoch milliseconds
        T.StructField("item_number", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("account_number", T.StringType()),
        T.StructField("amount", AMOUNT),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("approved", T.BooleanType()),
        T.StructField("description", T.StringType()),
    ]
)
EVENT_COLUMNS = tuple(EVENT.fieldNames())

# The stored table adds the attempt that wrote the row; it is a partition column.
STORED_EVENT = T.StructType([*EVENT.fields, T.StructField("attempt", T.StringType())])

ORDER_VIEW = T.StructType(
    [
        T.StructField("order_number", T.StringType()),
        T.StructField("account_number", T.StringType()),
        T.StructField("item_number", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("unit_price", UNIT_PRICE),
        T.StructField("quantity", T.IntegerType()),
    ]
)

REJECT = T.StructType(
    [
        T.StructField("do_key", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("item_number", T.StringType()),
        T.StructField("price_cents", T.LongType()),
    ]
)
BALANCES = T.StructType(
    [
        T.StructField("account_number", T.StringType()),
        T.StructField("balance", T.LongType()),
    ]
)
STOCK = T.StructType(
    [
        T.StructField("item_number", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("on_hand", T.IntegerType()),
    ]
)
