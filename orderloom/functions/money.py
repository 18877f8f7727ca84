"""Money arithmetic: prices are whole cents, event amounts are two-digit decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.schemas import AMOUNT, UNIT_PRICE


def cents_to_price(cents: Column) -> Column:
    """Whole cents as a unit price; a multiplication is cheaper than a decimal division."""
    return (cents.cast("decimal(10,0)") * F.lit(Decimal("0.01"))).cast(UNIT_PRICE)


def cents_to_amount(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(AMOUNT)


def to_cents(amount: Column) -> Column:
    """Decimal as 64-bit cents, so large amounts do not wrap."""
    return (amount * 100).cast("bigint")


def extended_amount(unit_price: Column, quantity: Column) -> Column:
    return (unit_price * quantity).cast(AMOUNT)


def whole_units(amount: Column) -> Column:
    """Drops the cents, toward zero."""
    return amount.cast("bigint")


def covers(balance: Column, amount: Column) -> Column:
    """Credit rule: the balance is compared with the amount less its cents."""
    return balance >= whole_units(amount)


def covers_cents(balance: Column, cents: Column) -> Column:
    """The same rule on 64-bit cents, which keeps decimals out of the hot loop."""
    return balance >= F.call_function("div", cents, F.lit(100))
