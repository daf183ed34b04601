"""Ready-made streaming queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saleslake import schemas, storage
from saleslake.functions.dates import day
from saleslake.layout import Layout
from saleslake.sinks.parts import PartTable
from saleslake.sinks.tables import WINDOW_RETENTION_DAYS
from saleslake.sources.events import accepted, decode, rejected
from saleslake.streaming import sinks
from saleslake.streaming.windows import add_partials, minute_partials, windowed_counts


def count_windows(
    messages: DataFrame,
    layout: Layout,
    checkpoint: str,
    extra_sinks: Sequence[sinks.Sink] = (),
    every: str | None = None,
    available_now: bool = False,
    console: bool = True,
) -> StreamingQuery:
    """Messages to closed windows, stored and, with `console`, printed by the driver."""
    counted = windowed_counts(accepted(decode(messages)))
    outputs = [*([sinks.console_sink()] if console else []), sinks.table_sink(layout), *extra_sinks]
    return sinks.start(counted, outputs, checkpoint, "transaction_windows", every, available_now)


def keep_rejected(
    messages: DataFrame, path: str, checkpoint: str, every: str | None = None, available_now: bool = False
) -> StreamingQuery:
    """Messages that cannot be decoded, kept as they came."""
    bad = rejected(decode(messages))
    return sinks.start(bad, [sinks.batch_table_sink(path)], checkpoint, "rejected_messages", every, available_now)


def count_minutes(
    events: DataFrame, path: str, checkpoint: str, every: str | None = None, available_now: bool = False
) -> StreamingQuery:
    """Per-minute partial counts of each batch; `read_minutes` adds them up, late events included."""
    output = sinks.batch_table_sink(path, minute_partials)
    return sinks.start(events, [output], checkpoint, "minute_partials", every, available_now)


def _day_of(name: str) -> date:
    return date.fromisoformat(name)


def minutes_by_day(spark: SparkSession, path: str) -> PartTable:
    """A table of counts per minute, a part per day, each sorted by minute."""
    day_name = F.date_format("window_start", "yyyy-MM-dd")
    return PartTable(spark, path, schemas.WINDOW_COUNTS, day_name, ["window_start"])


def read_days_of(table: PartTable, start: date | None = None, end: date | None = None) -> DataFrame:
    """The counts of some days (both included, None: unbounded); only the folders of these are listed."""
    return table.read(lambda name: (start is None or _day_of(name) >= start) and (end is None or _day_of(name) <= end))


def amend_minutes(
    events: DataFrame, path: str, checkpoint: str, every: str | None = None, available_now: bool = False
) -> StreamingQuery:
    """Published counts per minute that every batch amends, however late its events are; read with `minutes_by_day`.

    The stream keeps no state, so no event is too late. A batch's counts are merged into the days they belong to, once per batch number.
    """
    output = sinks.amending_sink(lambda spark: minutes_by_day(spark, path), minute_partials, add_partials)
    return sinks.start(events, [output], checkpoint, "amended_minutes", every, available_now, mode="update")


def _batches(spark: SparkSession, path: str, applied: Mapping[str, int]) -> dict[str, dict[int, str]]:
    """Folders of the completely written batches of each query that are not compacted yet, by batch number."""
    found: dict[str, dict[int, str]] = {}
    for marker in storage.matching(spark, f"{path}/query_id=*/batch_id=*/_SUCCESS"):
        folder = marker.rsplit("/", 1)[0]
        query, batch = (part.split("=", 1)[1] for part in folder.split("/")[-2:])
        if int(batch) > applied.get(query, -1):
            found.setdefault(query, {})[int(batch)] = folder
    return found


def _partials(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    if not folders:
        return schemas.empty(spark, schemas.WINDOW_COUNTS)
    return spark.read.schema(schemas.WINDOW_COUNTS).option("recursiveFileLookup", "true").parquet(*folders)


def compacted_minutes(spark: SparkSession, path: str) -> PartTable:
    return minutes_by_day(spark, f"{path}/compacted")


def compact_minutes(spark: SparkSession, path: str) -> int:
    """Fold the partial counts that `count_minutes` has stored into one sorted folder a day. Returns how many batches were.

    The new days and which batches are in them are published together; the batches' folders go after that. What is
    interrupted can be run again: a batch that is folded in already is neither read nor folded again.
    """
    table = compacted_minutes(spark, path)
    state = table.state()
    found = _batches(spark, path, state.applied)
    folders = [folder for of_query in found.values() for folder in of_query.values()]
    if folders:
        partials = add_partials(_partials(spark, folders)).persist()
        try:
            days = {row[0] for row in partials.select(table.part).distinct().collect()}  # names of days
            merged = add_partials(table.read(days, state).unionByName(partials))
            state = table.publish(state, table.write(merged) if days else {}, {query: max(batches) for query, batches in found.items()})
        finally:
            partials.unpersist()
    for query, last in state.applied.items():
        for batch in storage.partition_values(spark, f"{path}/query_id={query}", "batch_id"):
            if int(batch) <= last:
                storage.delete(spark, f"{path}/query_id={query}/batch_id={batch}")
    return len(folders)


def expire_minutes(spark: SparkSession, path: str, as_of: date, days: int = WINDOW_RETENTION_DAYS) -> list[date]:
    """Drop the compacted days that are older than `days` on `as_of`; returns them."""
    oldest = as_of - timedelta(days=days)
    return [_day_of(name) for name in compacted_minutes(spark, path).expire(lambda name: _day_of(name) < oldest)]


def read_minutes(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Totals per minute over all completely written batches, of some days or of all: compacted days, and the batches since."""
    table = compacted_minutes(spark, path)
    state = table.state()
    folders = [folder for of_query in _batches(spark, path, state.applied).values() for folder in of_query.values()]
    compacted = read_days_of(table, start, end)
    if not folders:
        return compacted
    since = _partials(spark, folders)
    on = F.to_date("window_start")
    if start is not None:
        since = since.where(on >= day(start))
    if end is not None:
        since = since.where(on <= day(end))
    return add_partials(compacted.unionByName(since))
