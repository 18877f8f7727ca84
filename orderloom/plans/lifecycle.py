"""Whole order lifecycle as one plan.

An order has one row through the whole chain, so the joins by order number between the steps
are not needed when the plan starts from requests: each lookup table is joined once, and every
event is a projection of the resulting row. ``operators.stages`` gives the same events from
separate feeds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.ids import order_number
from orderloom.functions.money import cents_to_amount, cents_to_price, covers_cents
from orderloom.operators.events import event_columns
from orderloom.operators.lookup import lookup_join
from orderloom.operators.stages import NO_ACCOUNT, NO_ID, NO_PRICE, NO_STOCK, stock_failure
from orderloom.schemas import (
    BALANCES,
    CREATE,
    CREDIT,
    EVENT_TYPES,
    PAYMENT,
    PRICE,
    PRICES,
    PULL,
    RESERVE,
    SHIP,
    STOCK,
)


class Lookups(NamedTuple):
    """The services' tables. ``check`` names those whose keys still have to be checked.

    A table left out is not joined, and no order reaches the steps that need it.
    """

    prices: DataFrame | None = None
    balances: DataFrame | None = None
    stock: DataFrame | None = None
    check: tuple[str, ...] = ("prices", "balances", "stock")


# In the order they are joined: stock stays within the items that prices have spread the requests by.
LOOKUP_TABLES = {
    "prices": (PRICES, ["item_number"]),
    "stock": (STOCK, ["item_number", "location"]),
    "balances": (BALANCES, ["account_number"]),
}


# Whether rows that are spread by item are shuffled again for a join by item and location.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def order_facts(
    requests: DataFrame, lookups: Lookups, require_success: bool = False, share_shuffle: bool = True
) -> DataFrame:
    """One row per request with everything its events need.

    ``created``, ``priced``, ``credited``, ``reserved``, ``paid`` and ``shipped`` tell how far
    the order got; a request without id is not created. By default denials and shortages do not
    stop it; ``require_success`` stops them. All events of an order carry its arrival time.

    The requests are the wide side of every join, so they are shuffled as few times and as narrow as
    can be: once by item for prices and stock, once by account, and numbered after that. One task then
    streams all requests of an item; with ``share_shuffle=False`` prices and stock have a shuffle each,
    which adaptive execution can split. This sets ``ALL_KEYS`` for the session, as Spark reads it when the
    plan runs.
    """
    rows = requests
    if lookups.prices is not None and lookups.stock is not None:
        requests.sparkSession.conf.set(ALL_KEYS, str(not share_shuffle).lower())
    for name, (schema, keys) in LOOKUP_TABLES.items():
        lookup, hit = getattr(lookups, name), f"has_{name}"
        if lookup is None:
            absent = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in keys}
            rows = rows.withColumns({**absent, hit: F.lit(False)})
        else:
            rows = lookup_join(rows, lookup, keys, hit, name in lookups.check)
    rows = rows.withColumn("do_key", order_number(F.col("request_id")))
    cents = F.col("price_cents") * F.col("quantity")
    approved = covers_cents(F.col("balance"), cents)
    failure = stock_failure(F.col("on_hand"), F.col("quantity"))
    created = F.col("do_key").isNotNull()
    has_price, has_stock, has_account = (
        F.col(f"has_{name}") for name in LOOKUP_TABLES
    )
    priced = created & has_price
    paid = priced & has_account & has_stock
    if require_success:
        paid = paid & F.coalesce(approved, F.lit(False)) & failure.isNull()
    return rows.select(
        "do_key",
        "request_id",
        "account_number",
        "item_number",
        "location",
        "quantity",
        F.col("arrived_ms").alias("event_time"),
        "price_cents",
        cents.alias("amount_cents"),
        approved.alias("approved"),
        failure.alias("stock_failure"),
        created.alias("created"),
        priced.alias("priced"),
        (priced & has_account).alias("credited"),
        (priced & has_stock).alias("reserved"),
        paid.alias("paid"),
        paid.alias("shipped"),
    )


# Column that tells whether an order has an event of the type.
REACHED = {
    CREATE: "created",
    PRICE: "priced",
    CREDIT: "credited",
    RESERVE: "reserved",
    PAYMENT: "paid",
    PULL: "paid",
    SHIP: "shipped",
}


def _payload(name: str) -> dict[str, Column]:
    columns = {f: F.col(f) for f in ("account_number", "item_number", "location", "quantity")}
    columns["approved"] = F.col("approved")
    columns["description"] = F.col("stock_failure")
    columns["amount"] = (
        cents_to_price(F.col("price_cents"))
        if name == PRICE
        else cents_to_amount(F.col("amount_cents"))
    )
    return columns


def events_of_type(facts: DataFrame, name: str) -> DataFrame:
    """Events of one type."""
    columns = event_columns(name, F.col("do_key"), _payload(name), F.col("event_time"))
    return facts.filter(F.col(REACHED[name])).select(*columns)


def all_events(facts: DataFrame) -> DataFrame:
    """Events of every type in one pass over the facts."""
    rows = [
        F.when(
            F.col(REACHED[name]),
            F.struct(*event_columns(name, F.col("do_key"), _payload(name), F.col("event_time"))),
        )
        for name in EVENT_TYPES
    ]
    return _spread(facts, rows, "event_name")


def _spread(facts: DataFrame, rows: list[Column], always_set: str) -> DataFrame:
    """One output row per struct that is not null.

    Null structs become null rows, found by a field that is always set; dropping them after
    ``inline`` keeps the plan in generated code, which filtering the array would not.
    """
    return facts.select(F.inline(F.array(*rows))).filter(F.col(always_set).isNotNull())


def all_rejects(facts: DataFrame) -> DataFrame:
    """Requests without id and orders that lacked a lookup row, with the step that needed it."""

    def reject(name: str, reason: str) -> Column:
        stage = F.lit(EVENT_TYPES[name].short_name)
        return F.struct(F.col("do_key"), stage.alias("stage"), F.lit(reason).alias("reason"))

    created, priced = F.col("created"), F.col("priced")
    rows = [
        F.when(~created, reject(CREATE, NO_ID)),
        F.when(created & ~priced, reject(PRICE, NO_PRICE)),
        F.when(priced & ~F.col("credited"), reject(CREDIT, NO_ACCOUNT)),
        F.when(priced & ~F.col("reserved"), reject(RESERVE, NO_STOCK)),
    ]
    return _spread(facts, rows, "stage")


def current_view(facts: DataFrame) -> DataFrame:
    """The order view straight from the facts, equal to folding all their events."""
    return facts.filter("created").select(
        F.col("do_key").alias("order_number"),
        "account_number",
        "item_number",
        "location",
        F.when(F.col("priced"), cents_to_price(F.col("price_cents"))).alias("unit_price"),
        "quantity",
    )


def lifecycle_summary(facts: DataFrame) -> DataFrame:
    """Outcome per order: what was approved, reserved and shipped, and the amount."""
    return facts.filter("created").select(
        F.col("do_key").alias("order_number"),
        F.col("approved"),
        (F.col("reserved") & F.col("stock_failure").isNull()).alias("reserved"),
        F.col("shipped"),
        F.col("amount_cents"),
    )
