"""The operators of the package run on the sample tables, one function per query."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from saleslake import schemas, storage
from saleslake.functions.dates import day, each_day
from saleslake.functions.money import line_amount
from saleslake.layout import Layout
from saleslake.operators import checks
from saleslake.operators.asof import asof_join
from saleslake.operators.attribution import attribute
from saleslake.operators.calendar import build_dim_date, missing_days
from saleslake.operators.dimensions import (
    empty_dimension,
    refresh_campaigns,
    refresh_customers,
    refresh_products,
)
from saleslake.operators.joins import hot_values, lookup_join
from saleslake.operators.unique_keys import narrow
from saleslake.plans import reports
from saleslake.plans.fact import build_sales, dropped_of, load_fact, resolve_headers, resolve_lines, touching
from saleslake.plans.pipeline import backfill, bootstrap, run_day
from saleslake.session import drops_shuffles, sort_in_memory, together
from saleslake.sinks.tables import (
    STAGING_RETENTION_DAYS,
    create_tables,
    drop_expired,
    refresh_history,
    replace_day,
    replace_history,
    retained,
    write_dimension,
)
from saleslake.sources.events import accepted, decode, rejected
from saleslake.sources.extracts import read_extract
from saleslake.sources.sample_tables import MOVING_DAY, SampleTables
from saleslake.sources.tables import read_dimension, read_fact, read_staging, read_window_counts
from saleslake.streaming import jobs, sinks
from saleslake.streaming.windows import add_partials, minute_partials, windowed_counts

LOADED_AT = datetime(2001, 1, 1, tzinfo=timezone.utc)

# What the partial catalogue and the first product and campaign extracts lack.
LATE_CATEGORY, DROPPED_CATEGORY = "PROMO", "SMALL"
LATE_CHANNEL, DROPPED_CHANNEL = "Phone", "Newsletter"

# Deliveries up to this day make up the fact that later deliveries are merged into.
FIRST_LOAD_UPTO = date(1998, 6, 30)
UPSERT_RANGE = (date(1998, 1, 1), date(1998, 6, 30))

# The days of the daily runs.
RUN_DAYS = (date(2001, 1, 1), date(2001, 1, 2), date(2001, 1, 3))

# The day of a customer extract that comes after later ones.
LATE_EXTRACT_DAY = date(1997, 6, 1)

# A load in steps is cut here, and some days around the cut are loaded again.
STEP_CUT, STEP_OVERLAP = date(1998, 1, 1), timedelta(days=30)

_samples: dict[tuple[str, str, int], SampleTables] = {}
_dimensions: dict[tuple[str, str, int], Layout] = {}
_stars: dict[tuple[str, str, int], Layout] = {}


def _input(spark: SparkSession, sf_dir: str) -> tuple[str, str, int]:
    """The application and the tables as they are now: what is kept for one input is not used for another."""
    return spark.sparkContext.applicationId, sf_dir, storage.state_of(spark, sf_dir)


def samples(spark: SparkSession, sf_dir: str) -> SampleTables:
    sort_in_memory(spark)
    key = _input(spark, sf_dir)
    if key not in _samples or _samples[key].spark is not spark:
        _samples[key] = SampleTables(spark, sf_dir)
    return _samples[key]


def scratch(spark: SparkSession, purpose: str) -> Layout:
    """An own, new place for tables in the folder the cluster shares."""
    folder = storage.work_dir(spark, f"{purpose}-{uuid4().hex[:12]}")
    storage.delete_at_exit(spark, folder)
    return Layout(folder, landing=f"{folder}/landing")


@drops_shuffles
def dimensions_of(spark: SparkSession, sf_dir: str) -> Layout:
    """The dimensions of the sample tables, loaded once per application and input; for queries that build their own fact."""
    key = _input(spark, sf_dir)
    if key not in _dimensions:
        t = samples(spark, sf_dir)
        layout = scratch(spark, "star")
        dimensions = {
            "dim_date": build_dim_date(spark, *t.sales_range),
            "dim_customer": dim_customer(t),
            "dim_product": refresh_products(empty_dimension(spark, "dim_product"), t.products(), LOADED_AT),
            "dim_campaign": refresh_campaigns(empty_dimension(spark, "dim_campaign"), t.campaigns(), LOADED_AT),
        }
        together(spark, [lambda n=n, rows=rows: write_dimension(rows, layout, n) for n, rows in dimensions.items()])
        _dimensions[key] = layout
    return _dimensions[key]


@drops_shuffles
def star(spark: SparkSession, sf_dir: str) -> Layout:
    """Dimensions and fact of the sample tables, loaded once per application and input.

    Checks and reports read stored tables, as they do in production, instead of rebuilding the star. They
    run over the whole history here, so the fact is stored without day partitions, which would bring
    them nothing; `fact_loaded_in_steps` stores and reads the partitioned table.
    """
    key = _input(spark, sf_dir)
    if key not in _stars:
        layout = dimensions_of(spark, sf_dir)
        sales(samples(spark, sf_dir), layout).write.parquet(_whole_fact(layout))
        _stars[key] = layout
    return _stars[key]


def _whole_fact(layout: Layout) -> str:
    return f"{layout.root}/fact_of_whole_history"


def dim_customer(t: SampleTables) -> DataFrame:
    start, _ = t.sales_range
    opened = refresh_customers(empty_dimension(t.spark, "dim_customer"), t.customers(), start)
    return refresh_customers(opened, t.customers(moved=True), MOVING_DAY)


def sales(
    t: SampleTables,
    layout: Layout,
    start: date | None = None,
    end: date | None = None,
    deliveries: DataFrame | None = None,
) -> DataFrame:
    """Fact rows of the sample tables against the stored dimensions of `layout`."""
    first, last = t.sales_range
    lines, headers = t.transaction_items() if deliveries is None else deliveries, t.transactions()
    if start or end:
        # The ids are read several times, so they are found once.
        folder = scratch(t.spark, "touched").root

        def keep(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{name}")
            return t.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

        lines, headers = touching(lines, headers, each_day(start or first, end or last), keep)
    return build_sales(
        t.newest_items(lines),
        t.newest_transactions(headers),
        read_dimension(t.spark, layout, "dim_customer"),
        read_dimension(t.spark, layout, "dim_product"),
        read_dimension(t.spark, layout, "dim_campaign"),
        start or first,
        end or last,
        hot_lines_from=lines,
        hot_headers_from=headers,
    )


def full_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.FACT_SALES).parquet(_whole_fact(star(spark, sf_dir)))


def dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_dimension(spark, dimensions_of(spark, sf_dir), name)


def partial_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension(spark, sf_dir, "dim_product").where(F.col("category") != LATE_CATEGORY)


# Calendar, deduplication, dimensions


def calendar_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_dim_date(spark, *samples(spark, sf_dir).sales_range)


def calendar_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to append to the calendar of the orders so that it covers all deliveries too."""
    t = samples(spark, sf_dir)
    return missing_days(build_dim_date(spark, *t.sales_range), *t.span("lineitem", "l_shipdate"))


def latest_line_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).newest_items()


def scd1_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extract renames and reprices products, brings a new category and lacks an old one."""
    products = samples(spark, sf_dir).products()
    first = products.where(F.col("category") != LATE_CATEGORY)
    second = products.where(F.col("category") != DROPPED_CATEGORY).withColumns(
        {"product_name": F.upper("product_name"), "price": (F.col("price") + 1).cast(schemas.MONEY)}
    )
    dim = refresh_products(empty_dimension(spark, "dim_product"), first, LOADED_AT)
    return refresh_products(dim, second, LOADED_AT).drop("updated_at")


def keys_after_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are product keys unique, and the same after a second load and a replay, with a hash of four times as many values as there are products?"""
    products = samples(spark, sf_dir).products()
    early = F.substring("product_id", 5, 20).cast("long") % 2 == 0
    hashed = narrow(4 * products.count())
    layout = scratch(spark, "collisions")

    def load(extract: DataFrame) -> DataFrame:
        write_dimension(refresh_products(read_dimension(spark, layout, "dim_product"), extract, LOADED_AT, hashed), layout, "dim_product")
        return read_dimension(spark, layout, "dim_product").select("product_id", "product_key")

    loads = [load(products.where(early)), load(products), load(products.where(early))]
    first, after = loads[1].withColumnRenamed("product_key", "first_key"), loads[2]
    rows_of_key = F.count(F.lit(1)).over(Window.partitionBy("product_key"))
    return after.join(first, "product_id", "left").select(
        "product_id", (rows_of_key == 1).alias("unique_key"), F.col("product_key").eqNullSafe(F.col("first_key")).alias("same_key")
    )


def scd1_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extract prolongs campaigns, brings a new channel and lacks an old one."""
    campaigns = samples(spark, sf_dir).campaigns()
    first = campaigns.where(F.col("channel") != LATE_CHANNEL)
    second = campaigns.where(F.col("channel") != DROPPED_CHANNEL).withColumn("end_date", F.date_add("end_date", 5))
    dim = refresh_campaigns(empty_dimension(spark, "dim_campaign"), first, LOADED_AT)
    return refresh_campaigns(dim, second, LOADED_AT).drop("updated_at")


def customer_loads(spark: SparkSession, layout: Layout, *loads: tuple[DataFrame, date]) -> DataFrame:
    """The stored customer history after some extracts, each known on a day."""
    replace_history(empty_dimension(spark, "dim_customer"), layout)
    for customers, on in loads:
        refresh_history(spark, layout, customers, on)
    return read_dimension(spark, layout, "dim_customer")


def scd2_customer_close_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples(spark, sf_dir)
    return customer_loads(spark, scratch(spark, "customers"), (t.customers(), t.sales_range[0]), (t.customers(moved=True), MOVING_DAY))


def scd2_late_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same loads, and after them a late extract of a day between, with other cities for one in five customers."""
    t = samples(spark, sf_dir)
    number = F.substring("customer_id", 5, 20).cast("long")
    late = t.customers().withColumn("city", F.when(number % 5 == 0, F.concat(F.lit("LATE_"), "city")).otherwise(F.col("city")))
    loads = ((t.customers(), t.sales_range[0]), (t.customers(moved=True), MOVING_DAY), (late, LATE_EXTRACT_DAY))
    return customer_loads(spark, scratch(spark, "customers"), *loads)


def campaign_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples(spark, sf_dir)
    orders = t.transactions().select("transaction_id", "transaction_date")
    return attribute(orders, t.campaigns(), *t.sales_range)


# Fact


def fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(samples(spark, sf_dir), dimensions_of(spark, sf_dir))


@drops_shuffles
def fact_upsert_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines delivered later merged into the stored fact of the earlier deliveries, for the sales of some months."""
    t = samples(spark, sf_dir)
    dimensions = dimensions_of(spark, sf_dir)
    items = t.transaction_items()
    early = F.col("ingest_date") <= day(FIRST_LOAD_UPTO)
    layout = scratch(spark, "upsert")
    create_tables(spark, layout)
    for deliveries in (items.where(early), items.where(~early)):
        load_fact(spark, layout, sales(t, dimensions, *UPSERT_RANGE, deliveries), *UPSERT_RANGE)
    return read_fact(spark, layout, *UPSERT_RANGE)


@drops_shuffles
def daily_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact after daily runs with late and corrected lines and moved orders, a backfill and a replay of the first day.

    The orders are dealt to three days. Some of the second are first delivered as of the first day; second lines of the
    first day come a day late; some first lines come with a wrong quantity and are corrected on the third day.
    """
    t = samples(spark, sf_dir)
    layout = scratch(spark, "daily")
    key = F.substring("transaction_id", 4, 20).cast("long")
    number = F.element_at(F.split("transaction_item_id", "-"), -1).cast("int")
    # Each day's extracts are cut out of both, so what is the newest is found out once.
    newest = {}
    for table, rows in {"transactions": t.newest_transactions(), "transaction_items": t.newest_items().drop("ingest_date")}.items():
        rows.write.parquet(f"{layout.root}/newest/{table}")
        newest[table] = spark.read.schema(rows.schema).parquet(f"{layout.root}/newest/{table}")
    headers = newest["transactions"].withColumns(
        {"nth": key % 3, "campaign_id": F.lit(None).cast("string"), "transaction_date": F.date_add(day(RUN_DAYS[0]), (key % 3).cast("int"))}
    )
    lines = newest["transaction_items"].withColumns({"nth": key % 3, "late": (key % 3 == 0) & (number == 2), "wrong": (key % 21 == 0) & (number == 1)})
    moved = headers.where((key % 15 == 1)).withColumns({"nth": F.lit(0), "transaction_date": day(RUN_DAYS[0])})
    first = F.col("nth") == 0
    quantity = F.when(F.col("wrong"), F.col("quantity") + 1).otherwise(F.col("quantity"))
    for n, on in enumerate(RUN_DAYS):
        extra = [lines.where(first & ~F.col("late")).withColumn("quantity", quantity), lines.where("late"), lines.where("wrong")][n]
        extracts = {
            "customers": t.customers(moved=True),
            "products": t.products(),
            "transactions": headers.where(F.col("nth") == n).unionByName(moved.where(F.col("nth") == n)),
            "transaction_items": extra if n == 0 else extra.unionByName(lines.where(F.col("nth") == n)),
            "marketing_campaigns": t.campaigns(),
        }
        for table, rows in extracts.items():
            columns = schemas.STAGING[table].fieldNames()
            rows.select(*columns).write.options(header=True, compression="gzip").csv(layout.daily_extract(table, on))
        if on == RUN_DAYS[-1]:
            storage.delete(spark, f"{layout.root}/newest")
        run_day(spark, layout, on)
    backfill(spark, layout, *RUN_DAYS[:2])
    run_day(spark, layout, RUN_DAYS[0])
    return read_fact(spark, layout, RUN_DAYS[0], RUN_DAYS[-1])


@drops_shuffles
def fact_loaded_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day-partitioned fact after loading two ranges and, again, the days around their border."""
    t = samples(spark, sf_dir)
    first, last = t.sales_range
    steps = [
        (first, STEP_CUT - timedelta(days=1)),
        (STEP_CUT, last),
        (STEP_CUT - STEP_OVERLAP, STEP_CUT + STEP_OVERLAP),
    ]
    dimensions = dimensions_of(spark, sf_dir)
    layout = scratch(spark, "steps")
    create_tables(spark, layout)
    for start, end in steps:
        load_fact(spark, layout, sales(t, dimensions, start, end), start, end)
    return read_fact(spark, layout, first, last)


def point_in_time_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the customer version of its day and its campaign's key or the unknown member."""
    t = samples(spark, sf_dir)
    resolved = resolve_headers(
        t.newest_transactions(),
        dimension(spark, sf_dir, "dim_customer"),
        dimension(spark, sf_dir, "dim_campaign"),
        *t.sales_range,
    )
    return resolved.select("transaction_id", "transaction_date", "customer_id", "customer_key", "campaign_key")


def rate_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payment with the rate of its account at that time, out of long histories of rates.

    One account has a third of all users. Every third event sets its account's rate for the next three days, or up to the next one.
    """
    events = samples(spark, sf_dir).events()
    number = F.col("transaction_id").cast("long")
    user = F.substring("customer_id", 5, 20).cast("long")
    accounts = events.withColumn("account", F.when(user % 3 == 0, F.lit("JOINT")).otherwise(F.col("customer_id")))
    starts = accounts.where(number % 3 == 0).groupBy("account", F.col("event_time").alias("since")).agg(F.max("amount").alias("rate"))
    following = F.lead("since").over(Window.partitionBy("account").orderBy("since")) - F.expr("INTERVAL 1 MICROSECOND")
    rates = starts.withColumn("until", F.least(F.col("since") + F.expr("INTERVAL 3 DAYS"), following))
    payments = accounts.where(number % 3 != 0).select("transaction_id", "account", "event_time")
    return asof_join(payments, rates, "account", "event_time", "since", "until", ["since", "rate"], ["transaction_id"], hot_values(payments, "account"))


@drops_shuffles
def bootstrap_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact after the one-time load of the whole history from one CSV per table, checks included."""
    t = samples(spark, sf_dir)
    layout = scratch(spark, "history")
    extracts = {
        "customers": t.customers(),
        "products": t.products(),
        "transactions": t.transactions(),
        "transaction_items": t.transaction_items(),
        "marketing_campaigns": t.campaigns(),
    }
    for table, rows in extracts.items():
        columns = schemas.STAGING[table].fieldNames()
        rows.select(*columns).write.options(header=True, compression="gzip").csv(Layout.history_extract(layout.landing, table))
    start, end = t.sales_range
    bootstrap(spark, layout, layout.landing, start, end)
    return read_fact(spark, layout, start, end)


# Loads and checks


def extract_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written as daily CSV extracts and loaded, one of the days twice."""
    layout = scratch(spark, "extracts")
    days = (date(2001, 1, 1), date(2001, 1, 2))
    headers = samples(spark, sf_dir).transactions().drop("ingest_date")
    create_tables(spark, layout)
    for on in days:
        headers.write.option("header", True).csv(layout.daily_extract("transactions", on))
    for on in (*days, days[0]):
        replace_day(read_extract(spark, layout, "transactions", on), layout, "transactions", on)
    return read_staging(spark, layout, "transactions")


def check_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples(spark, sf_dir)
    _, last = t.span("lineitem", "l_shipdate")
    return checks.landed(t.transaction_items(), last)


def check_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples(spark, sf_dir)
    return checks.reconcile(t.transaction_items(), t.transactions(), full_fact(spark, sf_dir), *t.sales_range)


def check_reconcile_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples(spark, sf_dir)
    return checks.reconcile(
        t.transaction_items(), t.transactions(), full_fact(spark, sf_dir), *t.sales_range, raw=True
    )


def check_reconcile_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the part of the fact a partial catalogue lets through, so the check has to fail."""
    t = samples(spark, sf_dir)
    fact = full_fact(spark, sf_dir)
    known = partial_catalogue(spark, sf_dir).select("product_key")
    kept = lookup_join(fact, known, "product_key", "left_semi", spread_on=["transaction_item_id"])
    return checks.reconcile(t.transaction_items(), t.transactions(), kept, *t.sales_range)


def fact_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the fact and one in which lines were lost, added, repeated, moved to another day or changed."""
    fact = full_fact(spark, sf_dir)
    number = F.substring("transaction_id", 4, 20).cast("long")
    kept = fact.where(number % 101 != 0)
    copies = fact.where(number % 103 == 0).withColumn("transaction_item_id", F.concat(F.lit("COPY-"), "transaction_item_id"))
    again = kept.where(number % 109 == 0)
    altered = kept.withColumns(
        {
            "quantity": F.when(number % 97 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")),
            "sale_date": F.when(number % 107 == 0, F.date_add("sale_date", 1)).otherwise(F.col("sale_date")),
        }
    )
    return checks.differences(fact, altered.unionByName(copies).unionByName(again), "transaction_item_id")


def dropped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples(spark, sf_dir)
    resolved = resolve_lines(
        t.newest_items(),
        t.newest_transactions(),
        dimension(spark, sf_dir, "dim_customer"),
        partial_catalogue(spark, sf_dir),
        dimension(spark, sf_dir, "dim_campaign"),
        *t.sales_range,
        hot_lines_from=t.transaction_items(),
        hot_headers_from=t.transactions(),
    )
    return dropped_of(resolved)


def header_total_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three headers state the sum of their lines, the others another amount."""
    t = samples(spark, sf_dir)
    items = t.newest_items()
    amount = line_amount(F.col("quantity"), F.col("price"))
    sums = items.groupBy("transaction_id").agg(F.sum(amount).alias("lines_total"))
    true = F.coalesce("lines_total", F.lit(0)).cast(schemas.MONEY)
    matches = F.substring("transaction_id", 4, 20).cast("long") % 3 < 2
    headers = t.newest_transactions().join(sums, "transaction_id", "left")
    stated = headers.withColumn("total_amount", F.when(matches, true).otherwise(F.col("total_amount")))
    return checks.header_total_mismatches(items, stated.drop("lines_total"))


def referential_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples(spark, sf_dir)
    campaigns = dimension(spark, sf_dir, "dim_campaign").where(F.col("channel") != LATE_CHANNEL)
    return checks.referential_gaps(
        t.newest_items(),
        t.newest_transactions(),
        dimension(spark, sf_dir, "dim_customer"),
        partial_catalogue(spark, sf_dir),
        campaigns,
    )


def retained_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples(spark, sf_dir)
    _, last = t.span("lineitem", "l_shipdate")
    kept = retained(t.transaction_items(), "ingest_date", last, STAGING_RETENTION_DAYS)
    return kept.groupBy("ingest_date").agg(F.count(F.lit(1)).alias("row_count"))


# Reports


def revenue_by_category_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.revenue_by_category_month(
        full_fact(spark, sf_dir), dimension(spark, sf_dir, "dim_product"), dimension(spark, sf_dir, "dim_date")
    )


def campaign_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.campaign_performance(full_fact(spark, sf_dir), dimension(spark, sf_dir, "dim_campaign"))


def cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cohort_retention(full_fact(spark, sf_dir), dimension(spark, sf_dir, "dim_customer"))


def cohort_retention_by_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cohort_retention(
        full_fact(spark, sf_dir), dimension(spark, sf_dir, "dim_customer"), by_signup=True
    )


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.order_metrics(full_fact(spark, sf_dir))


def sales_by_city_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_by_city(full_fact(spark, sf_dir), dimension(spark, sf_dir, "dim_customer"))


def product_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.product_performance(full_fact(spark, sf_dir), dimension(spark, sf_dir, "dim_product"))


def calendar_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.calendar_sales(full_fact(spark, sf_dir), dimension(spark, sf_dir, "dim_date"))


# Stream


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows the stream closed by the end of its input, read back from the window table.

    The input is history, so it is one batch: cut into several, rows of late files would count as late.
    """
    layout = scratch(spark, "windows")
    counted = windowed_counts(samples(spark, sf_dir).events(stream=True))
    query = sinks.start(counted, [sinks.table_sink(layout)], f"{layout.root}/checkpoint", available_now=True)
    query.awaitTermination()
    return read_window_counts(spark, layout)


def window_counts_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minute_partials(samples(spark, sf_dir).events())


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event rendered as a message, once whole and once cut short, so that it is no JSON any more."""
    fields = F.struct(
        "transaction_id",
        "customer_id",
        "amount",
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("event_time"),
    )
    whole = samples(spark, sf_dir).events().select(F.to_json(fields).alias("value"))
    cut = F.substring("value", F.lit(1), F.length("value") - 1)
    return whole.select(F.explode(F.array("value", cut)).alias("value"))


def event_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(decode(messages(spark, sf_dir)))


def event_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(decode(messages(spark, sf_dir)))


def late_inclusive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "minutes").root
    query = jobs.count_minutes(
        samples(spark, sf_dir).events(stream=True), f"{folder}/partials", f"{folder}/checkpoint", available_now=True
    )
    query.awaitTermination()
    return jobs.read_minutes(spark, f"{folder}/partials")


def late_amended_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per minute that five batches have amended, with events of the whole time in each, the last batch given twice."""
    folder = scratch(spark, "amended").root
    events = samples(spark, sf_dir).events_in_batches(f"{folder}/input", F.col("event_id") % 5, 5)
    query = jobs.amend_minutes(events, f"{folder}/minutes", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    table = jobs.minutes_by_day(spark, f"{folder}/minutes")
    table.merge(minute_partials(samples(spark, sf_dir).events()), add_partials, query.id, query.lastProgress["batchId"])
    return table.read()


def compacted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per minute of fifty batches, the first forty folded into a folder a day before the others came, all after it."""
    folder = scratch(spark, "compacted").root
    t = samples(spark, sf_dir)
    number = F.pmod(F.xxhash64("event_id"), F.lit(50))
    for part, in_part in enumerate((number < 40, number >= 40)):
        at = F.when(in_part, number % 40)
        events = t.events_in_batches(f"{folder}/input-{part}", at, (40, 10)[part])
        jobs.count_minutes(events, f"{folder}/partials", f"{folder}/checkpoint-{part}", available_now=True).awaitTermination()
        jobs.compact_minutes(spark, f"{folder}/partials")
    return jobs.read_minutes(spark, f"{folder}/partials")


def out_of_order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows closed over five batches by time, half of the events of the last eight seconds before a border one batch late."""
    layout = scratch(spark, "out-of-order")
    t = samples(spark, sf_dir)
    # The stream's first and last time: two values.
    low, high = t.table("events").agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))), F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(low)
    length = (high - low) // 5 + 1
    late = (F.col("event_id") % 2 == 0) & (at % length >= length - 8_000_000)
    events = t.events_in_batches(f"{layout.root}/input", F.least(F.lit(4), F.floor(at / length) + late.cast("int")), 5)
    sinks.start(windowed_counts(events), [sinks.table_sink(layout)], f"{layout.root}/checkpoint", available_now=True).awaitTermination()
    return read_window_counts(spark, layout)


def sinks_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per minute of two sinks that add what they get, with one between them that fails once, on the third batch."""
    folder = scratch(spark, "sinks").root
    events = samples(spark, sf_dir).events_in_batches(f"{folder}/input", F.col("event_id") % 5, 5)
    failures = []

    def adding(name: str) -> sinks.Sink:
        return lambda batch, number: minute_partials(batch).write.parquet(f"{folder}/{name}/{uuid4().hex}")

    def failing_once(batch: DataFrame, number: int) -> None:
        if number == 2 and not failures:
            failures.append(number)
            raise OSError("this sink is not there at the moment")

    def run() -> None:
        outputs = [adding("first"), failing_once, adding("second")]
        sinks.start(events, outputs, f"{folder}/checkpoint", available_now=True).awaitTermination()

    try:
        run()
    except StreamingQueryException:
        run()
    found = [
        add_partials(spark.read.schema(schemas.WINDOW_COUNTS).parquet(f"{folder}/{name}/*")).withColumn("sink", F.lit(name))
        for name in ("first", "second")
    ]
    return found[0].unionByName(found[1])


def expired_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the window table when days more than three days old are deleted."""
    layout = scratch(spark, "expired")
    counted = minute_partials(samples(spark, sf_dir).events())
    counted.withColumn("window_date", F.to_date("window_start")).write.partitionBy("window_date").parquet(layout.window_counts)
    last = max(storage.partition_days(spark, layout.window_counts, "window_date"))
    drop_expired(spark, layout.window_counts, "window_date", last, 3)
    return read_window_counts(spark, layout)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        calendar_dim,
        calendar_extend,
        latest_line_per_key,
        scd1_product,
        keys_after_collisions,
        scd1_campaign,
        scd2_customer_close_open,
        scd2_late_replay,
        campaign_attribution,
        fact_sales,
        fact_upsert_range,
        fact_loaded_in_steps,
        daily_runs,
        point_in_time_lookup,
        rate_as_of,
        bootstrap_history,
        extract_roundtrip,
        check_landed,
        check_reconcile,
        check_reconcile_raw,
        check_reconcile_partial,
        fact_differences,
        dropped_lines,
        header_total_mismatch,
        referential_gaps,
        retained_partitions,
        revenue_by_category_month,
        campaign_performance,
        cohort_retention,
        cohort_retention_by_signup,
        order_metrics,
        sales_by_city_asof,
        product_performance,
        calendar_sales,
        window_counts,
        window_counts_batch,
        event_decode,
        event_rejects,
        late_inclusive_counts,
        late_amended_counts,
        compacted_counts,
        out_of_order_windows,
        sinks_after_failure,
        expired_windows,
    )
}
