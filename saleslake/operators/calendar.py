"""Calendar dimension: one row per day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake.functions.dates import WEEKEND_DAYS, day
from saleslake.functions.keys import date_key


def each_day(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row (`full_date`) per day from `start` to `end`, both included."""
    return spark.range(1).select(F.explode(F.sequence(day(start), day(end))).alias("full_date"))


def build_dim_date(spark: SparkSession, start: date, end: date) -> DataFrame:
    d = F.col("full_date")
    return each_day(spark, start, end).select(
        date_key(d).alias("date_key"),
        d,
        F.dayofweek(d).cast("long").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofmonth(d).cast("long").alias("day_of_month"),
        F.month(d).cast("long").alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).cast("long").alias("quarter"),
        F.year(d).cast("long").alias("year"),
        F.dayofweek(d).isin(*WEEKEND_DAYS).alias("is_weekend"),
    )


def missing_days(existing: DataFrame, start: date, end: date) -> DataFrame:
    """Calendar rows of the range that `existing` lacks; empty when the range is already there."""
    wanted = build_dim_date(existing.sparkSession, start, end)
    return wanted.join(existing.select("date_key"), "date_key", "left_anti").select(*wanted.columns)


def extend_dim_date(existing: DataFrame, start: date, end: date) -> DataFrame:
    return existing.unionByName(missing_days(existing, start, end))
