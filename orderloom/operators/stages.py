"""The steps of an order as separate operators, each reading the feed of the step before.

Every step returns its events and the rows it could not handle. ``plans.lifecycle`` computes
the same events for whole requests in one pass; these are for callers that hold the feeds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.ids import order_number
from orderloom.functions.money import cents_to_price, covers, extended_amount, to_cents
from orderloom.operators.events import create_order_events, event_columns, hydrate
from orderloom.operators.lookup import lookup_join
from orderloom.schemas import CREATE, CREDIT, EVENT_TYPES, PAYMENT, PRICE, PULL, RESERVE, SHIP

# Reasons on rejected rows.
NO_ID = "no request id"
NO_PRICE = "no price for item"
NO_ORDER = "no order in view"
NO_ACCOUNT = "no balance for account"
NO_STOCK = "no stock row for item and location"
# Reason on a reservation or pull that fails.
INSUFFICIENT = "insufficient stock"


class StageResult(NamedTuple):
    events: DataFrame
    rejects: DataFrame


def _split(rows: DataFrame, hit: str, name: str, columns: list[Column], reason: str) -> StageResult:
    events = rows.filter(hit).select(*columns)
    return StageResult(events, _rejects(rows.filter(~F.col(hit)), name, reason))


def _rejects(rows: DataFrame, name: str, reason: str) -> DataFrame:
    return rows.select(
        "do_key",
        F.lit(EVENT_TYPES[name].short_name).alias("stage"),
        F.lit(reason).alias("reason"),
    )


def stock_failure(on_hand: Column, quantity: Column) -> Column:
    """Failure reason, or null when the stock covers the quantity."""
    enough = F.coalesce(on_hand >= quantity, F.lit(False))
    return F.when(~enough, F.lit(INSUFFICIENT))


def create_order(requests: DataFrame) -> StageResult:
    """Requests to Create events; a request without id cannot be numbered."""
    rows = requests.withColumn("do_key", order_number(F.col("request_id")))
    missing = _rejects(rows.filter(F.col("do_key").isNull()), CREATE, NO_ID)
    return StageResult(create_order_events(requests), missing)


def price_requests(created: DataFrame) -> DataFrame:
    return created.select("do_key", "item_number")


def price_lookup(created: DataFrame, prices: DataFrame) -> StageResult:
    """Create events to PriceLookup events; the amount is the unit price."""
    rows = lookup_join(created, prices, ["item_number"], "hit")
    payload = {
        "item_number": F.col("item_number"),
        "location": F.col("location"),
        "quantity": F.col("quantity"),
        "amount": cents_to_price(F.col("price_cents")),
    }
    columns = event_columns(PRICE, F.col("do_key"), payload, F.col("event_time"))
    return _split(rows, "hit", PRICE, columns, NO_PRICE)


def enrich(priced: DataFrame, order_view: DataFrame) -> StageResult:
    """PriceLookup events with the order's current row as struct ``order``."""
    current = order_view.select(
        F.col("order_number").alias("do_key"),
        F.struct(*[c for c in order_view.columns if c != "order_number"]).alias("order"),
    )
    rows = priced.join(current, "do_key", "left")
    found = rows.filter(F.col("order").isNotNull())
    missed = rows.filter(F.col("order").isNull())
    return StageResult(found, _rejects(missed, PRICE, NO_ORDER))


def balance_requests(enriched: DataFrame) -> DataFrame:
    return enriched.select("do_key", F.col("order.account_number").alias("account_number"))


def credit_check(enriched: DataFrame, balances: DataFrame) -> StageResult:
    """Enriched PriceLookup events to CreditCheck events; a denial is an event too."""
    orders = enriched.select("do_key", "event_time", "order.*")
    rows = lookup_join(orders, balances, ["account_number"], "hit")
    amount = extended_amount(F.col("unit_price"), F.col("quantity"))
    payload = {
        "account_number": F.col("account_number"),
        "amount": amount,
        "approved": covers(F.col("balance"), amount),
    }
    columns = event_columns(CREDIT, F.col("do_key"), payload, F.col("event_time"))
    return _split(rows, "hit", CREDIT, columns, NO_ACCOUNT)


def reserve_requests(enriched: DataFrame) -> DataFrame:
    return enriched.select("do_key", "order.item_number", "order.location", "order.quantity")


def reserve_inventory(enriched: DataFrame, stock: DataFrame) -> StageResult:
    """Enriched PriceLookup events to ReserveInventory events; a shortage is an event too."""
    return _take_stock(enriched.select("do_key", "event_time", "order.*"), stock, RESERVE)


def payment_requests(credit_reserve: DataFrame) -> DataFrame:
    """Account and 64-bit cents to collect for each credit and reservation pair."""
    return credit_reserve.select(
        "do_key",
        F.col("left.account_number").alias("account_number"),
        to_cents(F.col("left.amount")).alias("amount_cents"),
    )


def collect_payment(credit_reserve: DataFrame) -> DataFrame:
    """Credit and reservation pairs to CollectPayment events; the new balance is not used."""
    payload = {"account_number": F.col("left.account_number"), "amount": F.col("left.amount")}
    time = F.col("left.event_time")
    return credit_reserve.select(*event_columns(PAYMENT, F.col("do_key"), payload, time))


def pull_requests(credit_reserve: DataFrame) -> DataFrame:
    return credit_reserve.select("do_key", "right.item_number", "right.location", "right.quantity")


def pull_inventory(credit_reserve: DataFrame, stock: DataFrame) -> StageResult:
    """Credit and reservation pairs to PullInventory events."""
    fields = ("account_number", "item_number", "location", "quantity")
    orders = credit_reserve.select("do_key", "right.event_time", *[f"right.{f}" for f in fields])
    return _take_stock(orders, stock, PULL)


def ship_order(payment_pull: DataFrame) -> DataFrame:
    """Payment and pull pairs to ShipOrder events, all fields from the pull."""
    payload = {f: F.col(f"right.{f}") for f in EVENT_TYPES[SHIP].fields}
    time = F.col("right.event_time")
    return payment_pull.select(*event_columns(SHIP, F.col("do_key"), payload, time))


def succeeded(credit_reserve: DataFrame) -> DataFrame:
    """Opt-in filter: pairs whose credit was approved and whose reservation held."""
    return credit_reserve.filter(F.col("left.approved") & F.col("right.description").isNull())


def pulled(payment_pull: DataFrame) -> DataFrame:
    """Opt-in filter: pairs whose pull succeeded."""
    return payment_pull.filter(F.col("right.description").isNull())


def side_of(events: DataFrame, name: str) -> DataFrame:
    """Feed of one type as a pairing side: order key, time and that type's fields."""
    return hydrate(events, name).drop("sequence")


def _take_stock(orders: DataFrame, stock: DataFrame, name: str) -> StageResult:
    rows = lookup_join(orders, stock, ["item_number", "location"], "hit")
    payload = {
        "account_number": F.col("account_number"),
        "item_number": F.col("item_number"),
        "location": F.col("location"),
        "quantity": F.col("quantity"),
        "description": stock_failure(F.col("on_hand"), F.col("quantity")),
    }
    columns = event_columns(name, F.col("do_key"), payload, F.col("event_time"))
    return _split(rows, "hit", name, columns, NO_STOCK)
