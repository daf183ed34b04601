"""Sales fact: staged lines and headers resolved against the dimensions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake import schemas, storage
from saleslake.functions.dates import day, each_day, on_days, overlaps
from saleslake.functions.keys import UNKNOWN_KEY, date_key
from saleslake.functions.money import line_amount
from saleslake.layout import Layout
from saleslake.operators.asof import version_lookup
from saleslake.operators.joins import BROADCAST_LIMIT, MARKED_FROM, SLICES, hot_values, lookup_join, marked, measured_bytes, salted_join
from saleslake.operators.upsert import upsert
from saleslake.sinks.tables import write_fact
from saleslake.sources.tables import read_fact, read_fact_days


def resolve_headers(
    headers: DataFrame,
    customers: DataFrame,
    campaigns: DataFrame,
    start: date,
    end: date,
    hot_from: DataFrame | None = None,
    broadcast_limit: int = BROADCAST_LIMIT,
    days: Sequence[date] | None = None,
) -> DataFrame:
    """Transactions of the range, or of certain `days` in it, with the customer version of their day and their campaign's key.

    Done before the lines are joined because there are several lines per transaction. Versions that
    ended before the range or began after it are left out first; for a one-day load that leaves at most
    one version per customer. Where customers have long histories in the range, their versions are found by
    sorting, not by comparing all of them with each order. `hot_from` may name the undeduplicated headers, see `resolve_lines`.
    """
    in_days = on_days(F.col("transaction_date"), days or each_day(start, end))
    in_range = headers.where(in_days)
    sample = in_range if hot_from is None else hot_from.where(in_days)
    versions = customers.where(
        overlaps(F.col("effective_start_date"), F.col("effective_end_date"), start, end)
    ).select("customer_id", "customer_key", "effective_start_date", "effective_end_date")
    with_customer = version_lookup(
        in_range,
        versions,
        "customer_id",
        "transaction_date",
        "effective_start_date",
        "effective_end_date",
        ["customer_key"],
        spread_on=["transaction_id"],
        hot_from=sample.select("customer_id"),
        broadcast_limit=broadcast_limit,
        most=1 if start == end else None,
    )
    with_campaign = lookup_join(
        with_customer,
        campaigns.select("campaign_id", "campaign_key"),
        "campaign_id",
        "left",
        spread_on=["transaction_id"],
        hot_from=sample.select("campaign_id"),
        broadcast_limit=broadcast_limit,
    )
    return with_campaign.select(
        "transaction_id",
        "customer_id",
        "customer_key",
        F.coalesce("campaign_key", F.lit(UNKNOWN_KEY).cast("long")).alias("campaign_key"),
        "transaction_date",
        "total_amount",
    )


def resolve_lines(
    lines: DataFrame,
    headers: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    campaigns: DataFrame,
    start: date,
    end: date,
    hot_lines_from: DataFrame | None = None,
    hot_headers_from: DataFrame | None = None,
    broadcast_limit: int = BROADCAST_LIMIT,
    days: Sequence[date] | None = None,
) -> DataFrame:
    """Lines of the range's transactions with all their keys; a key that was not found is null.

    `lines` and `headers` must be unique on their ids. `hot_lines_from` and `hot_headers_from` may name
    the undeduplicated rows, where hot keys can be looked for without running the deduplication twice.
    """
    sample = lines if hot_lines_from is None else hot_lines_from
    resolved = resolve_headers(headers, customers, campaigns, start, end, hot_headers_from, broadcast_limit, days)
    wanted = lines.select("transaction_item_id", "transaction_id", "product_id", "quantity", "price")
    hot_transactions = hot_values(sample.select("transaction_id"), "transaction_id")
    # The renamed key column of `resolved` is dropped by the join; the line's own id remains.
    joined = salted_join(
        wanted, resolved, "transaction_id", "inner", spread_on=["transaction_item_id"], hot=hot_transactions
    )
    return lookup_join(
        joined,
        products.select("product_id", "product_key"),
        "product_id",
        "left",
        spread_on=["transaction_item_id"],
        hot_from=sample.select("product_id"),
        broadcast_limit=broadcast_limit,
    )


def sales_of(resolved: DataFrame) -> DataFrame:
    """Fact rows: the resolved lines that have a customer version and a product."""
    amount = line_amount(F.col("quantity"), F.col("price"))
    return resolved.where(F.col("customer_key").isNotNull() & F.col("product_key").isNotNull()).select(
        "transaction_item_id",
        "transaction_id",
        "customer_key",
        "product_key",
        "campaign_key",
        date_key(F.col("transaction_date")).alias("date_key"),
        F.col("transaction_date").alias("sale_date"),
        "quantity",
        F.col("price").alias("unit_price"),
        amount.alias("line_amount"),
        F.col("total_amount").alias("transaction_total_amount"),
    )


def dropped_of(resolved: DataFrame) -> DataFrame:
    """The resolved lines that do not make it into the fact, with the lookups that failed."""
    reason = F.concat_ws(
        ",",
        F.when(F.col("customer_key").isNull(), F.lit("customer")),
        F.when(F.col("product_key").isNull(), F.lit("product")),
    )
    return resolved.where(F.col("customer_key").isNull() | F.col("product_key").isNull()).select(
        "transaction_item_id", "transaction_id", "customer_id", "product_id", reason.alias("missing")
    )


def build_sales(*args, **kwargs) -> DataFrame:
    """Fact rows of a date range; see `resolve_lines` for the arguments."""
    return sales_of(resolve_lines(*args, **kwargs))


# From this share of all headers on, ranking all deliveries costs less than to look for those that matter and store them.
LARGE_SHARE = 1 / 3


def touching(
    lines: DataFrame,
    headers: DataFrame,
    days: Sequence[date],
    keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows,
    broadcast_limit: int = SLICES * BROADCAST_LIMIT,
    slice_bytes: int = MARKED_FROM,
) -> tuple[DataFrame, DataFrame]:
    """All deliveries of the lines and headers that can matter for sales on `days`; the rest needs no ranking.

    These are headers that any delivery dates to one of the days, and lines that any delivery gives to such a header,
    with all their deliveries. Where every header is on the days there is nothing to leave out. `keep` may store
    the ids and the deliveries.

    Lists of ids up to `slice_bytes` are broadcast, of longer ones just bits that mark them, so that the driver never holds a table of
    them; a few lines and headers that do not matter may then come along, with all their deliveries, and are left out once their newest
    delivery is known. Headers of more than `broadcast_limit` bytes are not worth looking for, nor is a long list of `LARGE_SHARE` of all headers:
    that would read the deliveries three times and store most of them, where ranking them all shuffles them once. So all are returned.
    """
    on = F.coalesce(on_days(F.col("transaction_date"), days), F.lit(False))
    if headers.where(~on).isEmpty():
        return lines, headers
    ids = keep(headers.where(on).select("transaction_id").distinct(), "headers")
    size = measured_bytes(ids)
    if size > broadcast_limit:
        return lines, headers
    if size > MARKED_FROM and headers.agg(F.avg(on.cast("int"))).first()[0] > LARGE_SHARE:
        return lines, headers

    def look(rows: DataFrame, found: DataFrame, key: str, spread_on: str) -> DataFrame:
        if measured_bytes(found) > slice_bytes:
            return marked(rows, found, key)
        return lookup_join(rows, found, key, "left_semi", [spread_on])

    of_headers = look(lines, ids, "transaction_id", "transaction_item_id")
    items = keep(of_headers.select("transaction_item_id").distinct(), "lines")
    touched = look(lines, items, "transaction_item_id", "ingest_date")
    # Both are read several times: to rank them, and to look for hot keys.
    return keep(touched, "touched-lines"), keep(look(headers, ids, "transaction_id", "ingest_date"), "touched-headers")


def days_of(lines: DataFrame, headers: DataFrame, on: date) -> list[date]:
    """The sale days that the deliveries of one day touch: of its headers, and of the headers of its lines.

    A header that was delivered before counts with its earlier days too, so that a line that moves leaves its old day.
    """
    delivered = F.col("ingest_date") == day(on)
    touched = headers.where(delivered).select("transaction_id").unionByName(lines.where(delivered).select("transaction_id")).distinct()
    dated = lookup_join(headers, touched, "transaction_id", "left_semi", ["ingest_date"])
    found = dated.where("transaction_date is not null").select("transaction_date").distinct().collect()  # days
    return sorted({on, *(row[0] for row in found)})


def changed_days(stored: DataFrame, sales: DataFrame) -> list[date]:
    """The days on which the two have other rows, told by the number of rows and the sum of their hashes per day."""
    columns = schemas.FACT_SALES.fieldNames()

    def by_day(rows: DataFrame, name: str) -> DataFrame:
        total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
        return rows.groupBy("sale_date").agg(F.struct(F.count(F.lit(1)), total).alias(name))

    both = by_day(stored, "before").join(by_day(sales, "after"), "sale_date", "full_outer")
    return sorted(row["sale_date"] for row in both.where(~F.col("before").eqNullSafe(F.col("after"))).select("sale_date").collect())  # days


def load_fact(
    spark: SparkSession, layout: Layout, sales: DataFrame, start: date, end: date, days: Sequence[date] | None = None, stored: bool = False
) -> None:
    """Merge `sales` into the stored fact partitions `start`..`end`, or certain `days`; repeating it changes nothing.

    A line already stored on these days is rewritten whole, also if its day changed among them.
    Days without stored partitions, the normal case of a daily run, need no merge join at all. Of days with stored
    partitions only those are merged and rewritten on which `sales` differ from what is stored: a line that moves makes both its
    days differ, and a day whose rows are the same keeps its files. `stored` says that `sales` are read from stored files, so that
    they need not be written before they are read to compare and again to merge.
    """
    days = days or each_day(start, end)
    existing = read_fact_days(spark, layout, days)
    if existing.isEmpty():
        return write_fact(sales, layout, days)
    folder = storage.work_dir(spark, f"sales-to-merge-{uuid4().hex}")
    try:
        if not stored:
            # Read to compare and again to merge, so it is built once.
            sales.write.parquet(folder)
            sales = spark.read.schema(schemas.FACT_SALES).parquet(folder)
        changed = changed_days(existing, sales)
        if changed:
            # All sales take part: a line that is right on a day that stays may have an old row on one that changes.
            merged = upsert(read_fact_days(spark, layout, changed), sales, "transaction_item_id")
            write_fact(merged.where(on_days(F.col("sale_date"), changed)), layout, changed)
    finally:
        storage.delete(spark, folder)


def stray_lines(spark: SparkSession, layout: Layout, start: date, end: date, first: date, last: date) -> DataFrame:
    """Lines of the range that are also stored on a day outside of it, within `first`..`last`.

    A transaction whose date moves across the edge of a load range leaves its old row behind; loading
    the wider range removes it.
    """
    everything = read_fact(spark, layout, first, last).select("transaction_item_id", "sale_date")
    inside = F.col("sale_date").between(day(start), day(end))
    return (
        everything.groupBy("transaction_item_id")
        .agg(F.count_if(inside).alias("inside"), F.min(F.when(~inside, F.col("sale_date"))).alias("stray_sale_date"))
        .where((F.col("inside") > 0) & F.col("stray_sale_date").isNotNull())
        .select("transaction_item_id", "stray_sale_date")
    )
