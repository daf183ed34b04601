"""Readers of the stored tables."""

from __future__ import annotations

from collections.abc import Callable, Collection
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saleslake import schemas, storage
from saleslake.functions.dates import day
from saleslake.layout import Layout
from saleslake.sinks.parts import PartTable


class MissingRange(ValueError):
    """The sales fact must not be scanned without a date range."""


def read_days(
    spark: SparkSession,
    path: str,
    schema: StructType,
    column: str,
    start: date | None = None,
    end: date | None = None,
    days: Collection[date] | None = None,
) -> DataFrame:
    """Rows of a day-partitioned table from `start` to `end` (both included, None = unbounded), or of certain `days`.

    Only the directories of the range are listed, so the cost of planning a one-day read does not grow
    with the table's history. The filter stays in the plan as well and shows as a partition filter.
    """
    every = storage.partition_days(spark, path, column)
    wanted = [d for d in every if (start is None or d >= start) and (end is None or d <= end) and (days is None or d in days)]
    if not wanted:
        return schemas.empty(spark, schema)
    paths = [path] if len(wanted) == len(every) else [f"{path}/{column}={d.isoformat()}" for d in wanted]
    rows = spark.read.schema(schema).option("basePath", path).parquet(*paths)
    if start is not None:
        rows = rows.where(F.col(column) >= day(start))
    if end is not None:
        rows = rows.where(F.col(column) <= day(end))
    return rows.select(*schema.fieldNames())


def read_staging(
    spark: SparkSession, layout: Layout, table: str, upto: date | None = None, since: date | None = None
) -> DataFrame:
    """All retained deliveries of a table, with their delivery day; `upto` hides later deliveries."""
    return read_days(spark, layout.staging(table), schemas.staged(table), "ingest_date", since, upto)


def read_staging_day(spark: SparkSession, layout: Layout, table: str, on: date) -> DataFrame:
    return read_staging(spark, layout, table, upto=on, since=on)


def read_fact(spark: SparkSession, layout: Layout, start: date, end: date) -> DataFrame:
    """Sales lines of a date range. The range is mandatory: the fact is too large to scan by accident."""
    if start is None or end is None:
        raise MissingRange("fact_sales can only be read for a start and an end date")
    return read_days(spark, layout.fact_sales, schemas.FACT_SALES, "sale_date", start, end)


def read_fact_days(spark: SparkSession, layout: Layout, days: Collection[date]) -> DataFrame:
    """Sales lines of certain days, whose folders alone are read."""
    return read_days(spark, layout.fact_sales, schemas.FACT_SALES, "sale_date", min(days), max(days), set(days))


def committed_snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the completely written snapshots of an unpartitioned table, ascending."""
    numbers = (int(v) for v in storage.partition_values(spark, path, "snapshot"))
    return sorted(n for n in numbers if storage.exists(spark, f"{path}/snapshot={n}/_SUCCESS"))


# The part of the customer history that open versions are in; closed ones are in the month in which they end.
OPEN_VERSIONS = "open"


def customer_history(spark: SparkSession, layout: Layout) -> PartTable:
    """Customer versions by the month that they end in, open ones apart."""
    part = F.coalesce(F.date_format("effective_end_date", "yyyy-MM"), F.lit(OPEN_VERSIONS))
    return PartTable(spark, layout.dimension("dim_customer"), schemas.DIM_CUSTOMER, part, ["customer_id"])


def ends_since(since: date) -> Callable[[str], bool]:
    """Whether a part of the customer history can have versions that are valid on `since` or later."""
    return lambda name: name == OPEN_VERSIONS or name >= f"{since:%Y-%m}"


def read_versions(spark: SparkSession, layout: Layout, since: date) -> DataFrame:
    """Customer versions, at least all that are valid on `since` or later; months before it are not read."""
    return customer_history(spark, layout).read(ends_since(since))


def read_dimension(spark: SparkSession, layout: Layout, name: str) -> DataFrame:
    """The newest complete snapshot; an empty frame when there is none yet."""
    if name == "dim_customer":
        return customer_history(spark, layout).read()
    path = layout.dimension(name)
    snapshots = committed_snapshots(spark, path)
    schema = schemas.DIMENSIONS[name]
    if not snapshots:
        return schemas.empty(spark, schema)
    return spark.read.schema(schema).parquet(f"{path}/snapshot={snapshots[-1]}")


def read_window_counts(
    spark: SparkSession, layout: Layout, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Closed windows written by the stream, optionally for a range of days."""
    schema = StructType(list(schemas.WINDOW_COUNTS.fields)).add("window_date", "date")
    rows = read_days(spark, layout.window_counts, schema, "window_date", start, end)
    return rows.select(*schemas.WINDOW_COUNTS.fieldNames())


def register_views(spark: SparkSession, layout: Layout, start: date, end: date) -> None:
    """Temporary views of all tables for SQL users; `fact_sales` is limited to the given range."""
    for name in schemas.DIMENSIONS:
        read_dimension(spark, layout, name).createOrReplaceTempView(name)
    for table in schemas.STAGING:
        read_staging(spark, layout, table).createOrReplaceTempView(f"stg_{table}")
    read_fact(spark, layout, start, end).createOrReplaceTempView("fact_sales")
    read_window_counts(spark, layout, start, end).createOrReplaceTempView("transaction_window_counts")
