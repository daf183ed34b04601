"""Which campaign was running on a transaction's day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.functions.dates import day
from saleslake.operators.dedup import latest_per_key
from saleslake.operators.joins import lookup_join


def campaign_by_day(campaigns: DataFrame, start: date, end: date) -> DataFrame:
    """One campaign per day of the range on which any was active (both end days count).

    Where several overlap, the most recently started one wins, then the smallest id.
    """
    first, last = F.greatest("start_date", day(start)), F.least("end_date", day(end))
    days = (
        campaigns.where((F.col("start_date") <= day(end)) & (F.col("end_date") >= day(start)))
        .where(F.col("start_date") <= F.col("end_date"))
        .select("campaign_id", "start_date", F.explode(F.sequence(first, last)).alias("active_day"))
    )
    picked = latest_per_key(days, ["active_day"], newest="start_date", tiebreakers=["campaign_id"])
    return picked.select("active_day", F.col("campaign_id").alias("active_campaign_id"))


def attribute(
    transactions: DataFrame, campaigns: DataFrame, start: date, end: date, eligible: Column | None = None
) -> DataFrame:
    """`transactions` of the range with `campaign_id` set to the day's campaign where `eligible` holds.

    An interval condition would be compared for all pairs; expanding each campaign to its days makes it
    an equality. The lookup has at most one row per day of the range, which bounds what is broadcast.
    """
    by_day = campaign_by_day(campaigns, start, end)
    dated = transactions.drop("campaign_id")
    by_day = by_day.withColumnRenamed("active_day", "transaction_date")
    # Broadcast if its measured size allows, else joined with the busy days spread.
    joined = lookup_join(dated, by_day, "transaction_date", "left", ["transaction_id"])
    campaign = F.col("active_campaign_id")
    if eligible is not None:
        campaign = F.when(eligible, campaign)
    return joined.withColumn("campaign_id", campaign).drop("active_campaign_id")
