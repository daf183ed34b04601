"""Outputs of a streaming query. A sink is a function of the batch's rows and its number."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saleslake import storage
from saleslake.layout import Layout
from saleslake.session import setting
from saleslake.sinks.parts import PartTable

Sink = Callable[[DataFrame, int], None]

# Events are counted per window before they are shuffled, so what reaches the state is a few rows per
# window and task, however many events there are. Each partition more only adds files to every commit.
STATE_PARTITIONS = 8


def window_line() -> F.Column:
    """The printed form of a closed window."""
    start = F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.format_string(
        "[%s] transactions=%d total_amount=%s",
        start,
        F.col("transaction_count"),
        F.format_number("total_amount", 2),
    )


def console_sink(write: Callable[[str], object] = print) -> Sink:
    """Prints each closed window, oldest first. Rows come to the driver a partition at a time."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        for row in batch.orderBy("window_start").select(window_line().alias("line")).toLocalIterator():
            write(row["line"])

    return emit


def query_id(batch: DataFrame) -> str:
    """Identity of the running query; a restart from the same checkpoint keeps it."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def table_sink(layout: Layout) -> Sink:
    """Appends closed windows to the window table, by day.

    Each batch of a query owns its sub-partitions and overwrites them, so a batch that is repeated after
    a failure leaves no duplicates. Any write error fails the query.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("window_date", F.to_date("window_start"))
            .withColumn("query_id", F.lit(query_id(batch)))
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .hint("rebalance", "window_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("window_date", "query_id", "batch_id")
            .parquet(layout.window_counts)
        )

    return emit


def batch_table_sink(path: str, transform: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Sink:
    """Stores `transform` of each batch as that batch's partition below `path`; repeating replaces it."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/query_id={query_id(batch)}/batch_id={batch_id}")

    return emit


def amending_sink(table: Callable[[SparkSession], PartTable], transform: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame]) -> Sink:
    """Combines `transform` of each batch with the stored rows of the parts it touches, once per batch number.

    All parts change together, and a batch that is repeated after a failure changes nothing.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        table(batch.sparkSession).merge(transform(batch), combine, query_id(batch), batch_id)

    return emit


def composite_sink(sinks: Sequence[Sink], ledger: str | None = None) -> Sink:
    """Gives each batch to all sinks in order, computing it once.

    In the folder `ledger`, if given, it is noted which sinks have got a batch. When the batch is repeated because a later sink
    failed, those get it no second time; only a sink whose note could not be written does.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        notes = f"{ledger}/{query_id(batch)}"
        batch.persist()
        try:
            for n, sink in enumerate(sinks):
                note = f"{notes}/{batch_id}/{n}"
                if ledger and storage.exists(spark, note):
                    continue
                sink(batch, batch_id)
                if ledger:
                    storage.touch(spark, note)
        finally:
            batch.unpersist()
        # Once a batch has begun, the ones before are never repeated.
        for earlier in storage.names(spark, notes) if ledger else []:
            if int(earlier) < batch_id:
                storage.delete(spark, f"{notes}/{earlier}")

    return emit


def start(
    rows: DataFrame,
    sinks: Sequence[Sink],
    checkpoint: str,
    name: str | None = None,
    every: str | None = None,
    available_now: bool = False,
    state_partitions: int = STATE_PARTITIONS,
    mode: str = "append",
) -> StreamingQuery:
    """Start a query that feeds `sinks`; of several each gets each batch once, as noted beside the checkpoint.

    Batches run back to back, or `every` so often (such as "5 minutes", which makes fewer and larger
    files); `available_now` stops at the end of the input. A restarted query keeps the number of
    `state_partitions` its checkpoint was made with.
    """
    # The state's partitions are those of the session when the query starts; what the sinks run gets the cluster's back.
    usual = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    every_sink = composite_sink(sinks, f"{checkpoint}/delivered") if len(sinks) > 1 else sinks[0]

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.sparkSession.conf.set("spark.sql.shuffle.partitions", usual)
        every_sink(batch, batch_id)

    writer = (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(emit)
    )
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    with setting(rows.sparkSession, "spark.sql.shuffle.partitions", str(state_partitions)):
        return writer.start()
