"""Exact prices and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saleslake import schemas

# More decimals than money has, so that what a cast to money would round can be seen.
_WIDE = "decimal(38,18)"
_TOO_LONG = r"\.[0-9]{18}0*[1-9]"

# What surely fits money as it is, so that it need not be compared with a wider number.
_PLAIN = r"^[+-]?[0-9]{1,18}(\.[0-9]{1,9})?\z"


def exact_money(text: Column) -> Column:
    """The number in `text` as money; null if it is no number or has more digits than money holds."""
    wide = text.try_cast(_WIDE)
    money = wide.try_cast(schemas.MONEY)
    exact = F.when((money == wide) & ~text.rlike(_TOO_LONG), money)
    return F.when(text.rlike(_PLAIN), text.try_cast(schemas.MONEY)).otherwise(exact)


def line_amount(quantity: Column, price: Column) -> Column:
    """Price times whole pieces, without rounding."""
    return (quantity.cast("int") * price).cast(schemas.AMOUNT)
