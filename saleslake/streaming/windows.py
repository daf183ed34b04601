"""One-minute event-time windows over the transaction stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.functions.dates import minute_start

# Length of a window, and how long a late event can still reach it.
WINDOW_LENGTH = "1 minute"
ALLOWED_LATENESS = "10 seconds"

_TOTAL = "decimal(38,9)"


def windowed_counts(
    events: DataFrame, window: str = WINDOW_LENGTH, lateness: str = ALLOWED_LATENESS
) -> DataFrame:
    """Count and amount per tumbling window of `event_time`, for a stream in append mode.

    A window is emitted once, when the watermark (greatest event time seen minus `lateness`) reaches its
    end. Events for windows already emitted are dropped and counted by Spark; `minute_partials` is the
    way to totals that include them.
    """
    return (
        events.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").cast(_TOTAL).alias("total_amount"))
        .select(F.col("w.start").alias("window_start"), "transaction_count", "total_amount")
    )


def minute_partials(events: DataFrame) -> DataFrame:
    """Count and amount per minute of a batch of events, without any window ever being closed."""
    return events.groupBy(minute_start(F.col("event_time")).alias("window_start")).agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").cast(_TOTAL).alias("total_amount")
    )


def add_partials(partials: DataFrame) -> DataFrame:
    """Totals per minute from any number of partial counts of the same minute."""
    return partials.groupBy("window_start").agg(
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("total_amount").cast(_TOTAL).alias("total_amount"),
    )
