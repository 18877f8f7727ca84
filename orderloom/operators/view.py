"""Current state per key: the order view, and last value per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.schemas import CREATE, EVENT, PRICE, PULL, RESERVE, UNIT_PRICE

# Which event types write each column of the view.
SETTERS: dict[str, tuple[str, ...]] = {
    "account_number": (CREATE,),
    "item_number": (CREATE, PRICE),
    "location": (CREATE, PRICE),
    "unit_price": (PRICE,),
    "quantity": (CREATE, PRICE, RESERVE, PULL),
}
# Types that change an order and so need it to exist; the others leave the view as it is.
NEEDS_ORDER = (PRICE, RESERVE, PULL)
CHANGES_ORDER = (CREATE, *NEEDS_ORDER)
NO_CREATE = "changed before it was created"


def _column(name: str) -> str:
    return "amount" if name == "unit_price" else name


def state_schema() -> T.StructType:
    """One row per order: each column's last value with the sequence that set it, and two bounds."""
    kinds = {f.name: f.dataType for f in EVENT.fields}
    last = [
        T.StructField(name, T.StructType([T.StructField("at", T.LongType()), T.StructField("value", kinds[_column(name)])]))
        for name in SETTERS
    ]
    bounds = [T.StructField(n, T.LongType()) for n in ("created_at", "used_at")]
    return T.StructType([T.StructField("do_key", T.StringType()), *last, *bounds])


def as_state(events: DataFrame) -> DataFrame:
    """Each event as the state it would make alone.

    Types that change nothing are filtered out first, which on the stored table skips their
    folders. A value set by nothing yet is null; one that an event set to null is not.
    """
    name, at = F.col("event_name"), F.col("sequence")
    columns = [
        F.when(name.isin(*setters), F.struct(at.alias("at"), F.col(_column(column)).alias("value"))).alias(column)
        for column, setters in SETTERS.items()
    ]
    created = F.when(name == CREATE, at).alias("created_at")
    used = F.when(name.isin(*NEEDS_ORDER), at).alias("used_at")
    return events.filter(name.isin(*CHANGES_ORDER)).select("do_key", *columns, created, used)


def fold_states(states: DataFrame) -> DataFrame:
    """States of the same order as one; folding states of parts of a log gives that of the log.

    Partial results combine before the shuffle, so one very long chain stays one row per map task.
    """
    last = [F.max(column).alias(column) for column in SETTERS]
    bounds = [F.min(c).alias(c) for c in ("created_at", "used_at")]
    return states.groupBy("do_key").agg(*last, *bounds)


def unfold(states: DataFrame) -> DataFrame:
    """The folded columns of each order, without the sequences that set them."""
    return states.select("do_key", *[F.col(f"{c}.value").alias(c) for c in SETTERS], "created_at", "used_at")


def fold(events: DataFrame) -> DataFrame:
    """One row of folded columns per order."""
    return unfold(fold_states(as_state(events)))


def _well_formed() -> Column:
    return F.col("created_at").isNotNull() & (
        F.col("used_at").isNull() | (F.col("created_at") < F.col("used_at"))
    )


def view_rows(folded: DataFrame) -> DataFrame:
    return folded.filter(_well_formed()).select(
        F.col("do_key").alias("order_number"),
        "account_number",
        "item_number",
        "location",
        F.col("unit_price").cast(UNIT_PRICE).alias("unit_price"),
        "quantity",
    )


def order_view(events: DataFrame) -> DataFrame:
    """Folds events into one row per order.

    Each column is the value of the highest-sequence event that sets it, so the fold is a
    single grouped aggregation with map-side combining; one very long chain stays one row
    per map task.
    """
    return view_rows(fold(events))


def order_view_as_of(events: DataFrame, sequence: int) -> DataFrame:
    """The view rebuilt from the events up to and including a sequence number."""
    return order_view(events.filter(F.col("sequence") <= sequence))


def reject_rows(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("used_at").isNotNull() & ~_well_formed()).select(
        "do_key", F.lit("OrderView").alias("stage"), F.lit(NO_CREATE).alias("reason")
    )


def view_rejects(events: DataFrame) -> DataFrame:
    """Keys with an event that changes an order before any Create event."""
    return reject_rows(fold(events))


def latest_per_key(rows: DataFrame, key: str, *order_by: str) -> DataFrame:
    """Last row of each key by ``order_by``.

    The remaining columns follow in the comparison, so equal positions still give one answer.
    """
    rest = [c for c in rows.columns if c != key and c not in order_by]
    last = rows.groupBy(key).agg(F.max(F.struct(*order_by, *rest)).alias("last"))
    return last.select(*[key if c == key else f"last.{c}" for c in rows.columns])
