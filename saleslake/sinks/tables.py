"""Writers of the stored tables. Every write can be repeated without leaving duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import ExitStack
from datetime import date, timedelta
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saleslake import schemas, storage
from saleslake.functions.dates import day
from saleslake.layout import Layout
from saleslake.operators.dimensions import customer_changes
from saleslake.operators.joins import lookup_join
from saleslake.operators.upsert import DuplicateKeys, require_unique
from saleslake.session import setting, together
from saleslake.sinks.parts import State
from saleslake.sources.tables import committed_snapshots, customer_history, ends_since

# How long partitions are kept.
STAGING_RETENTION_DAYS = 30
WINDOW_RETENTION_DAYS = 90

# Sort keys within a table's files, so that row-group statistics let filters on them skip data.
DIMENSION_CLUSTERING = {
    "dim_date": (),
    "dim_product": ("category", "product_id"),
    "dim_campaign": ("channel",),
}
FACT_CLUSTERING = ("customer_key", "product_key", "campaign_key")

SNAPSHOTS_KEPT = 2

# Shuffle partitions over which the days of a load are dealt at most. Spark records the size of each up to 2,000.
DAY_PARTITIONS = 1_000

# Columns with hardly a value that repeats within a file, for which dictionaries would be built in vain.
FACT_IDS = ("transaction_item_id", "transaction_id")


def create_tables(spark: SparkSession, layout: Layout) -> None:
    """Make every table that does not exist yet, empty and with its partitioning."""
    window_schema = StructType(list(schemas.WINDOW_COUNTS.fields)).add("window_date", "date")
    partitioned = [(layout.staging(table), schemas.staged(table), "ingest_date") for table in schemas.STAGING]
    partitioned.append((layout.fact_sales, schemas.FACT_SALES, "sale_date"))
    partitioned.append((layout.window_counts, window_schema, "window_date"))
    steps = [
        lambda path=path, schema=schema, column=column: (
            schemas.empty(spark, schema).write.partitionBy(column).parquet(path)
        )
        for path, schema, column in partitioned
        if not storage.exists(spark, path)
    ]
    steps += [
        lambda name=name: write_dimension(schemas.empty(spark, schemas.DIMENSIONS[name]), layout, name)
        for name in schemas.DIMENSIONS
        if not (customer_history(spark, layout).commits() if name == "dim_customer" else committed_snapshots(spark, layout.dimension(name)))
    ]
    if steps:
        together(spark, steps)


def replace_day(rows: DataFrame, layout: Layout, table: str, on: date) -> int:
    """Make `rows` the whole content of one delivery day; other days stay. Returns the row count.

    The partition is swapped only after the job succeeded, so a rejected load leaves the old content.
    A load without rows writes no partition at all; then the old one is dropped. Deliveries are kept for some weeks and
    are mostly ids and amounts, so no dictionaries are built for them.
    """
    path = layout.staging(table)
    counted = Observation()
    (
        rows.observe(counted, F.count(F.lit(1)).alias("rows"))
        .withColumn("ingest_date", day(on))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.enable.dictionary", "false")
        .partitionBy("ingest_date")
        .parquet(path)
    )
    loaded = counted.get["rows"]
    if loaded == 0:
        storage.delete(rows.sparkSession, f"{path}/ingest_date={on.isoformat()}")
    return loaded


def replace_all(rows: DataFrame, layout: Layout, table: str, on: date) -> int:
    """Make `rows`, delivered on `on`, the whole content of a staging table. Returns the row count.

    The other days go only after the new content is in place.
    """
    spark = rows.sparkSession
    loaded = replace_day(rows, layout, table, on)
    path = layout.staging(table)
    for other in storage.partition_days(spark, path, "ingest_date"):
        if other != on:
            storage.delete(spark, f"{path}/ingest_date={other.isoformat()}")
    return loaded


def write_dimension(rows: DataFrame, layout: Layout, name: str) -> None:
    """Store a new snapshot. Readers switch to it once it is complete and its keys are unique; older ones go away later.

    Surrogate keys are hashes, so their uniqueness is checked on what was written; the snapshot is published only then, and
    after a failure readers keep the one before.

    Range partitioning on the clustering columns gives files with disjoint key ranges. Customers are stored as a history, which
    this replaces whole; `refresh_history` changes just what a load changes.
    """
    spark = rows.sparkSession
    if name == "dim_customer":
        return replace_history(rows, layout)
    path = layout.dimension(name)
    snapshots = committed_snapshots(spark, path)
    rows = rows.select(*schemas.DIMENSIONS[name].fieldNames())
    clustering = DIMENSION_CLUSTERING[name]
    if clustering:
        rows = rows.repartitionByRange(*clustering).sortWithinPartitions(*clustering)
    number = snapshots[-1] + 1 if snapshots else 0
    written = f"{path}/snapshot={number}"
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(written)
    key = schemas.DIMENSIONS[name].fieldNames()[0]
    require_unique(spark.read.schema(schemas.DIMENSIONS[name]).parquet(written).select(key), [key], name)
    storage.mark_complete(spark, written)
    for old in snapshots[: -SNAPSHOTS_KEPT + 1 or None]:
        storage.delete(spark, f"{path}/snapshot={old}")


def replace_history(rows: DataFrame, layout: Layout) -> None:
    """Make `rows` the whole customer history, if their keys are unique."""
    spark = rows.sparkSession
    table = customer_history(spark, layout)
    before = table.state()
    written = table.write(rows)
    after = State(parts=written)
    require_unique(table.read(state=after).select("customer_key"), ["customer_key"], "dim_customer")
    table.publish(before, {**{name: [] for name in before.parts}, **written})


def refresh_history(spark: SparkSession, layout: Layout, customers: DataFrame, as_of: date, first_start: date | None = None) -> None:
    """Apply the customers known on `as_of` to the stored history, as `refresh_customers` does.

    Read are the open versions and those closed since the month of `as_of`, which a daily load has hardly any of. Versions that
    close are appended to their month; a month is rewritten only if a late replay splits one of its versions. All parts change
    together, and only if the new keys are unique among themselves and all stored ones.
    """
    table = customer_history(spark, layout)
    state = table.state()
    folder = storage.work_dir(spark, f"customer-changes-{uuid4().hex}")
    try:
        found = customer_changes(table.read(ends_since(as_of), state), customers, as_of, first_start=first_start)
        found.write.parquet(folder)
        changes = spark.read.schema(found.schema).parquet(folder)
        removed = changes.where("old IS NOT NULL").select("old.*")
        added = changes.select(F.explode("versions").alias("v")).select("v.*")
        if changes.isEmpty():
            return
        gone = removed.select("customer_key")
        fresh = lookup_join(added.select("customer_key", "customer_id"), gone, "customer_key", "left_anti", ["customer_id"])
        require_unique(added.select("customer_key"), ["customer_key"], "dim_customer")
        stored_keys = table.read(state=state).select("customer_key", "customer_id")
        if not lookup_join(stored_keys, fresh.select("customer_key"), "customer_key", "left_semi", ["customer_id"]).isEmpty():
            raise DuplicateKeys("dim_customer has several rows for one customer_key")
        split = {row[0] for row in removed.select(table.part).distinct().collect()}  # names of months
        in_split = table.part.isin(sorted(split)) if split else F.lit(False)
        staying = lookup_join(table.read(split, state), gone, "customer_key", "left_anti", ["customer_id"])
        rewritten = table.write(staying.unionByName(added.where(in_split))) if split else {}
        appended = table.write(added.where(~in_split))
        parts = {name: rewritten.get(name, []) for name in split}
        parts |= {name: [*state.parts.get(name, []), *folders] for name, folders in appended.items()}
        table.publish(state, parts)
    finally:
        storage.delete(spark, folder)


def append_calendar(missing: DataFrame, existing: DataFrame, layout: Layout) -> None:
    """Add the days that are missing; nothing is written when there are none."""
    if not missing.isEmpty():
        write_dimension(existing.unionByName(missing), layout, "dim_date")


def write_fact(rows: DataFrame, layout: Layout, days: Sequence[date]) -> None:
    """Replace the sales partitions of `days` by `rows`, which must all lie on them.

    Rebalancing by day lets adaptive execution cut a large day into several tasks; sorting in each task
    clusters its files. Days are dealt over many partitions: one that exceeds the advisory size is cut by the tasks it came
    from, which gives every day in it a file per cut. A load of many days merges partitions only as far as there are cores, since
    every day is a file of its own and a task with little data may still have hundreds of them to write.
    Partitions that get no rows any more (all their lines moved to another day) are not touched by a dynamic
    overwrite, so they are dropped afterwards; which days got rows is recorded by the write itself.
    """
    spark = rows.sparkSession
    path = layout.fact_sales
    written = Observation()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(days), DAY_PARTITIONS))
    merging = {} if len(days) == 1 else {"parallelismFirst": "true", "minPartitionSize": "16k"}
    with ExitStack() as changed:
        for key, value in merging.items():
            changed.enter_context(setting(spark, f"spark.sql.adaptive.coalescePartitions.{key}", value))
        (
            rows.select(*schemas.FACT_SALES.fieldNames())
            .observe(written, F.collect_set(F.date_format("sale_date", "yyyy-MM-dd")).alias("days"))
            .hint("rebalance", partitions, "sale_date")
            .sortWithinPartitions("sale_date", *FACT_CLUSTERING)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .options(**{f"parquet.enable.dictionary#{column}": "false" for column in FACT_IDS})
            .partitionBy("sale_date")
            .parquet(path)
        )
    try:
        got_rows = set(written.get["days"])
    except Py4JJavaError:
        # Nothing is observed of a plan that turns out to be empty at run time.
        if not rows.isEmpty():
            raise
        got_rows = set()
    emptied = {d.isoformat() for d in days} - got_rows
    for existing in storage.partition_values(spark, path, "sale_date"):
        if existing in emptied:
            storage.delete(spark, f"{path}/sale_date={existing}")


def retained(rows: DataFrame, column: str, as_of: date, days: int) -> DataFrame:
    """Rows of partitions that are not older than `days` on `as_of`."""
    return rows.where(F.col(column) >= day(as_of - timedelta(days=days)))


def drop_expired(spark: SparkSession, path: str, column: str, as_of: date, days: int) -> list[date]:
    """Delete the partitions `retained` would hide; returns the days dropped."""
    oldest = as_of - timedelta(days=days)
    expired = [d for d in storage.partition_days(spark, path, column) if d < oldest]
    for d in expired:
        storage.delete(spark, f"{path}/{column}={d.isoformat()}")
    return expired


def apply_retention(spark: SparkSession, layout: Layout, as_of: date) -> None:
    for table in schemas.STAGING:
        drop_expired(spark, layout.staging(table), "ingest_date", as_of, STAGING_RETENTION_DAYS)
    drop_expired(spark, layout.window_counts, "window_date", as_of, WINDOW_RETENTION_DAYS)
