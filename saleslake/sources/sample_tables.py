"""Model inputs taken from order-processing tables (customer, nation, part, orders, lineitem, events).

The tables have no campaigns, no customer changes and no delivery days, so those are derived from the
data: a campaign starts every 98 days of the order history, some customers move on one date, and a line
counts as delivered on its ship date. Line ids repeat in the data, which stands for lines that were
delivered more than once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake import schemas, storage
from saleslake.functions.dates import day
from saleslake.operators.attribution import attribute
from saleslake.operators.dedup import latest_per_key

# Fixed values of the derivation.
CHANNELS = ("Newsletter", "Radio", "Posters", "Web", "Partners", "Phone")
CAMPAIGN_EVERY_DAYS = 98
CAMPAIGN_LENGTH_DAYS = 30
SIGNUP_BASE = date(1995, 1, 1)
MOVING_DAY = date(1998, 1, 1)

# Files a batch of a replayed stream has at most.
FILES_A_BATCH = 8

# What a line's ids are made of, by which its deliveries are ranked.
LINE_KEY = ("l_orderkey", "l_linenumber")

# Settles which copy of a line is the newest when several came on one day.
LINE_TIEBREAK = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


class SampleTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._spans: dict[tuple[str, str], tuple[date, date]] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def span(self, table: str, column: str) -> tuple[date, date]:
        """First and last day in a column."""
        if (table, column) not in self._spans:
            d = F.col(column).cast("date")
            row = self.table(table).agg(F.min(d).alias("first"), F.max(d).alias("last")).first()
            self._spans[table, column] = (row["first"], row["last"])
        return self._spans[table, column]

    @property
    def sales_range(self) -> tuple[date, date]:
        return self.span("orders", "o_orderdate")

    def campaigns(self) -> DataFrame:
        ordered = F.col("o_orderdate").cast("date")
        span = self.table("orders").agg(F.min(ordered).alias("first"), F.max(ordered).alias("last"))
        count = F.floor(F.datediff("last", "first") / CAMPAIGN_EVERY_DAYS).cast("int")
        numbered = span.select("first", F.explode(F.sequence(F.lit(1), count)).alias("n"))
        i = F.col("n") - 1
        start = F.date_add("first", i * CAMPAIGN_EVERY_DAYS)
        channel = F.element_at(F.array(*map(F.lit, CHANNELS)), (i % len(CHANNELS)) + 1)
        return numbered.select(
            F.concat(F.lit("CAMP"), i.cast("string")).alias("campaign_id"),
            F.concat_ws(" ", F.date_format(start, "yyyy-MM"), F.lower(channel)).alias("campaign_name"),
            start.alias("start_date"),
            F.date_add(start, CAMPAIGN_LENGTH_DAYS).alias("end_date"),
            channel.alias("channel"),
        )

    def transactions(self) -> DataFrame:
        """Order headers; two of five that fall into a campaign carry its id."""
        start, end = self.sales_range
        headers = self.table("orders").select(
            _id("TXN", "o_orderkey").alias("transaction_id"),
            _id("CUST", "o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("transaction_date"),
            F.col("o_totalprice").cast(schemas.MONEY).alias("total_amount"),
            (F.col("o_orderkey") % 5 < 2).alias("attributed"),
            F.col("o_orderdate").cast("date").alias("ingest_date"),
        )
        with_campaign = attribute(headers, self.campaigns(), start, end, eligible=F.col("attributed"))
        return with_campaign.select(*schemas.STAGING["transactions"].fieldNames(), "ingest_date")

    def newest_transactions(self, deliveries: DataFrame | None = None) -> DataFrame:
        deliveries = self.transactions() if deliveries is None else deliveries
        return latest_per_key(deliveries, ["transaction_id"]).drop("ingest_date")

    def transaction_items(self) -> DataFrame:
        """All deliveries of all lines, with the columns of the line's key and those that settle ties."""
        return self.table("lineitem").select(
            *self._line(), F.col("l_shipdate").cast("date").alias("ingest_date"), *LINE_KEY, *LINE_TIEBREAK
        )

    @staticmethod
    def _line() -> list[Column]:
        """A line as staged, from the columns of its key and those that settle ties."""
        return [
            F.concat(_id("TXN", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias(
                "transaction_item_id"
            ),
            _id("TXN", "l_orderkey").alias("transaction_id"),
            _id("PROD", "l_partkey").alias("product_id"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.col("l_extendedprice").cast(schemas.MONEY).alias("price"),
        ]

    def newest_items(self, deliveries: DataFrame | None = None) -> DataFrame:
        """The newest delivery of each line, out of `deliveries` (default: all of them).

        Numbers are ranked, and the ids and amounts made of what is left: rows of a third of the size are sorted and shuffled.
        """
        deliveries = self.transaction_items() if deliveries is None else deliveries
        # Lines without an id are one line, whichever part of it is missing.
        whole = F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
        ranked = deliveries.select(*LINE_KEY, "ingest_date", *LINE_TIEBREAK, *(F.when(whole, F.col(c)).alias(f"_{c}") for c in LINE_KEY))
        newest = latest_per_key(ranked, [f"_{c}" for c in LINE_KEY], tiebreakers=LINE_TIEBREAK)
        return newest.select(*self._line(), "ingest_date")

    def products(self) -> DataFrame:
        return self.table("part").select(
            _id("PROD", "p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast(schemas.MONEY).alias("price"),
        )

    def customers(self, moved: bool = False) -> DataFrame:
        """Customer extract before (`moved=False`) or after one in seven customers changed city."""
        nations = self.table("nation").select("n_nationkey", "n_name")
        city = F.col("n_name")
        if moved:
            city = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("MOVED_"), city)).otherwise(city)
        # A nation per row of a fixed list of nations: Spark broadcasts it by its file size.
        located = self.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return located.select(
            _id("CUST", "c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            city.alias("city"),
            F.date_sub(day(SIGNUP_BASE), (F.col("c_custkey") % 365).cast("int")).alias("signup_date"),
        )

    def events(self, stream: bool = False) -> DataFrame:
        """The event table as transactions, read as a table or as a stream of its files."""
        if stream:
            # As a glob the path is accepted for a single file as well as for a folder of files.
            source = self.spark.readStream.schema(self.table("events").schema).parquet(
                f"{self.sf_dir}/[e]vents.parquet"
            )
        else:
            source = self.table("events")
        return self._payments(source)

    def events_in_batches(self, folder: str, number: Column, batches: int) -> DataFrame:
        """The event table as a stream that comes in `batches` batches: `number` says in which (from 0) an event is.

        The batches' files are written to `folder` in their order, which is the order the stream reads them in.
        """
        table = self.table("events")
        numbered = table.withColumn("batch", number.cast("int"))
        for n in range(batches):
            numbered.where(F.col("batch") == n).drop("batch").coalesce(FILES_A_BATCH).write.mode("overwrite").parquet(f"{folder}/{n:04}")
        found = storage.matching(self.spark, f"{folder}/*/*.parquet")
        # Each batch has as many files, or few: then one file is read at a time and there are more batches.
        several = {n: sum(f"/{n:04}/" in name for name in found) for n in range(batches)}
        at_once = several[0] if len(set(several.values())) == 1 else 1
        stream = self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", at_once).parquet(f"{folder}/*/*.parquet")
        return self._payments(stream)

    @staticmethod
    def _payments(source: DataFrame) -> DataFrame:
        return source.select(
            F.col("event_id").cast("string").alias("transaction_id"),
            _id("CUST", "user_id").alias("customer_id"),
            F.col("value").cast(schemas.MONEY).alias("amount"),
            F.col("ts").cast("timestamp").alias("event_time"),
        )
