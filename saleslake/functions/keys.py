"""Surrogate keys and date keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key of the "no campaign" member; surrogate keys are never negative, so it cannot collide.
UNKNOWN_KEY = -1

_LOW_63_BITS = 0x7FFF_FFFF_FFFF_FFFF


def surrogate_key(*parts: Column) -> Column:
    """A stable non-negative 63-bit key from one or more string columns joined by '|'.

    Depends only on the values, so a replay or a retried task gives the same key. Null if any part is.
    """
    text = parts[0] if len(parts) == 1 else F.concat(*[p for part in parts for p in (F.lit("|"), part)][1:])
    leading_64_bits = F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")
    return leading_64_bits.bitwiseAND(F.lit(_LOW_63_BITS))


def date_key(day: Column) -> Column:
    """yyyymmdd as a number."""
    return F.date_format(day, "yyyyMMdd").cast("long")
