import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from conftest import d, money, rows_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from saleslake import storage
from saleslake.functions.dates import minute_start
from saleslake.sources.events import accepted, decode, read_topic, rejected
from saleslake.sources.tables import read_window_counts
from saleslake.streaming import jobs, sinks
from saleslake.streaming.windows import add_partials, minute_partials, windowed_counts

NOON = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)


def message(seconds, amount, **changes):
    fields = {
        "transaction_id": f"id-{seconds}",
        "customer_id": "CUST000001",
        "amount": amount,
        "event_time": (NOON + timedelta(seconds=seconds)).isoformat(),
    }
    return json.dumps({**fields, **changes})


class Topic:
    """A folder of text files that stands in for the topic: one file, one micro-batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.files = spark, folder, 0
        os.makedirs(folder)

    def send(self, *messages):
        path = os.path.join(self.folder, f"{self.files:04}.txt")
        with open(path, "w") as f:
            f.write("\n".join(messages) + "\n")
        os.utime(path, (1_700_000_000 + self.files,) * 2)
        self.files += 1

    def stream(self):
        return self.spark.readStream.option("maxFilesPerTrigger", 1).text(self.folder)


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, str(tmp_path / "topic"))


def run(topic, layout, tmp_path, *extra):
    query = jobs.count_windows(topic.stream(), layout, str(tmp_path / "checkpoint"), extra, available_now=True)
    query.awaitTermination()
    return query


def windows(spark, layout):
    found = rows_of(read_window_counts(spark, layout))
    return [(w.replace(tzinfo=timezone.utc) - NOON, n, total) for w, n, total in found]


MINUTE = timedelta(minutes=1)


def test_minute_start(spark):
    row = spark.sql("SELECT timestamp'2026-01-01 12:00:47' AS t").select(minute_start(F.col("t")).alias("m")).first()
    assert row["m"] == datetime(2026, 1, 1, 12)


def test_window_is_emitted_only_after_the_watermark_passes_its_end(spark, topic, layout, tmp_path):
    for seconds, amount in [(0, 100), (30, 50), (65, 10)]:
        topic.send(message(seconds, amount))
    run(topic, layout, tmp_path)
    assert windows(spark, layout) == []
    topic.send(message(75, 10))
    run(topic, layout, tmp_path)
    assert windows(spark, layout) == [(timedelta(0), 2, money("150"))]


def test_late_event_within_the_grace_period_counts_in_its_window(spark, topic, layout, tmp_path):
    for seconds, amount in [(58, 100), (61, 5), (55, 20), (130, 1)]:
        topic.send(message(seconds, amount))
    run(topic, layout, tmp_path)
    assert windows(spark, layout) == [(timedelta(0), 2, money("120")), (MINUTE, 1, money("5"))]


def test_watermark_equal_to_the_window_end_closes_it(spark, topic, layout, tmp_path):
    topic.send(message(0, 100))
    topic.send(message(70, 10))
    run(topic, layout, tmp_path)
    assert windows(spark, layout) == [(timedelta(0), 1, money("100"))]


def test_watermark_just_before_the_window_end_does_not(spark, topic, layout, tmp_path):
    topic.send(message(0, 100))
    topic.send(message(69, 10))
    run(topic, layout, tmp_path)
    assert windows(spark, layout) == []


TOO_LATE = [(0, 1), (75, 1), (76, 1), (5, 1), (200, 1), (6, 1)]


def test_events_for_closed_windows_are_dropped_and_counted(spark, topic, layout, tmp_path):
    for seconds, amount in TOO_LATE:
        topic.send(message(seconds, amount))
    query = run(topic, layout, tmp_path)
    assert windows(spark, layout) == [(timedelta(0), 1, money("1")), (MINUTE, 2, money("2"))]
    dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    assert dropped == 2


def test_minute_totals_include_late_events_and_the_open_window(spark, topic, tmp_path):
    for seconds, amount in TOO_LATE:
        topic.send(message(seconds, amount))
    folder, checkpoint = str(tmp_path / "partials"), str(tmp_path / "checkpoint")
    assert jobs.read_minutes(spark, folder).isEmpty()
    jobs.count_minutes(accepted(decode(topic.stream())), folder, checkpoint, available_now=True).awaitTermination()
    totals = rows_of(jobs.read_minutes(spark, folder), "transaction_count", "total_amount")
    assert sorted(totals) == [(1, money("1")), (2, money("2")), (3, money("3"))]


def test_restart_continues_open_windows(spark, topic, layout, tmp_path):
    topic.send(message(10, 1))
    run(topic, layout, tmp_path)
    topic.send(message(20, 2), message(70, 5))
    run(topic, layout, tmp_path)
    assert windows(spark, layout) == [(timedelta(0), 2, money("3"))]


def test_stream_equals_batch_over_shuffled_arrival(spark, layout, topic, tmp_path):
    offsets = [(i * 7919) % 1800 for i in range(1800)]
    topic.send(*(message(s, s % 13) for s in offsets))
    run(topic, layout, tmp_path)
    batch = minute_partials(accepted(decode(spark.read.text(topic.folder))))
    closed = batch.where(F.col("window_start") + F.expr("INTERVAL 1 MINUTE") <= F.lit(NOON + timedelta(seconds=1789)).cast("timestamp"))
    assert len(windows(spark, layout)) == 29
    assert rows_of(read_window_counts(spark, layout)) == rows_of(closed)


def test_sinks_all_get_each_batch_and_console_prints_in_order(spark, topic, layout, tmp_path, capsys):
    topic.send(*(message(s, 1234.5) for s in (130, 5, 65)), message(400, 1))
    seen = []
    run(topic, layout, tmp_path, lambda batch, batch_id: seen.extend(batch.collect()))
    printed = [line for line in capsys.readouterr().out.splitlines() if line.startswith("[")]
    assert printed == [
        f"[2026-01-01T12:0{minute}:00Z] transactions=1 total_amount=1,234.50" for minute in (0, 1, 2)
    ]
    assert len(seen) == 3 and len(windows(spark, layout)) == 3


def test_repeated_batch_leaves_no_duplicates_and_queries_do_not_mix(spark, layout):
    batch = spark.createDataFrame([(NOON, 1, money("5")), (NOON + timedelta(days=1), 2, money("6"))], "window_start timestamp, transaction_count long, total_amount decimal(38,9)")
    sink = sinks.table_sink(layout)
    context = spark.sparkContext
    for query in ("one", "one", "two"):
        context.setLocalProperty("sql.streaming.queryId", query)
        sink(batch, 0)
    context.setLocalProperty("sql.streaming.queryId", None)
    assert read_window_counts(spark, layout).count() == 4
    assert read_window_counts(spark, layout, d("2026-01-02"), d("2026-01-02")).count() == 2


def test_failing_sink_fails_the_query(spark, topic, layout, tmp_path):
    def broken(batch, batch_id):
        raise RuntimeError("no space")

    topic.send(message(0, 1), message(100, 1))
    with pytest.raises((PySparkException, Py4JJavaError)):
        run(topic, layout, tmp_path, broken)


BAD = [
    "not json",
    '{"transaction_id": "x"',
    message(0, "much"),
    message(0, 1, event_time="yesterday"),
    message(0, 1, event_time=None),
    message(0, None),
    "[]",
]


def test_bad_messages_are_kept_apart_and_the_stream_goes_on(spark, topic, layout, tmp_path):
    topic.send(message(0, 1), *BAD, message(100, 1))
    run(topic, layout, tmp_path)
    assert windows(spark, layout) == [(timedelta(0), 1, money("1"))]
    folder = str(tmp_path / "rejected")
    jobs.keep_rejected(topic.stream(), folder, str(tmp_path / "checkpoint2"), available_now=True).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(folder).select("value").collect()) == sorted(BAD)


def test_decode_reads_offsets_fractions_and_bytes(spark):
    texts = [
        message(0, 10.25, event_time="2026-01-01T19:00:00.250000+07:00"),
        message(0, 10.25, event_time="2026-01-01T12:00:00Z"),
    ]
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "value binary")
    times = [r["event_time"].replace(tzinfo=timezone.utc) for r in accepted(decode(frame)).collect()]
    assert times == [NOON + timedelta(milliseconds=250), NOON]
    assert rejected(decode(frame)).isEmpty()


def test_message_is_parsed_once(spark):
    plan = accepted(decode(spark.createDataFrame([("{}",)], "value string")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_partial_counts_add_up(spark):
    partials = spark.createDataFrame([(NOON, 1, money("1")), (NOON, 2, money("2"))], "window_start timestamp, transaction_count long, total_amount decimal(38,9)")
    assert rows_of(add_partials(partials), "transaction_count", "total_amount") == [(3, money("3"))]


def test_topic_source_names_the_connector_when_it_is_missing(spark):
    try:
        frame = read_topic(spark)
    except PySparkException as e:
        assert "kafka" in str(e).lower()
    else:
        assert frame.isStreaming


def test_window_length_and_lateness_are_parameters(spark, topic, layout, tmp_path):
    for seconds in (0, 299, 330):
        topic.send(message(seconds, 1))
    rows = windowed_counts(accepted(decode(topic.stream())), "5 minutes", "30 seconds")
    sinks.start(rows, [sinks.table_sink(layout)], str(tmp_path / "c"), available_now=True).awaitTermination()
    assert windows(spark, layout) == [(timedelta(0), 2, money("2"))]


def test_number_of_state_partitions_is_kept_small(spark, topic, layout, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    topic.send(message(0, 1))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        query = run(topic, layout, tmp_path)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert query.lastProgress.stateOperators[0].numShufflePartitions == sinks.STATE_PARTITIONS


def every_minute(spark, path, **between):
    return [(w.replace(tzinfo=timezone.utc) - NOON, n, total) for w, n, total in rows_of(jobs.read_minutes(spark, path, **between))]


def counting(spark, topic, tmp_path):
    return jobs.count_minutes(accepted(decode(topic.stream())), str(tmp_path / "partials"), str(tmp_path / "checkpoint"), available_now=True)


def test_late_events_amend_published_minutes(spark, topic, tmp_path):
    path, checkpoint = str(tmp_path / "minutes"), str(tmp_path / "checkpoint")

    def amend():
        query = jobs.amend_minutes(accepted(decode(topic.stream())), path, checkpoint, available_now=True)
        query.awaitTermination()
        return query

    def stored():
        return [(w.replace(tzinfo=timezone.utc) - NOON, n, total) for w, n, total in rows_of(jobs.minutes_by_day(spark, path).read())]

    topic.send(message(0, 1), message(70, 2))
    topic.send(message(7200, 3))
    amend()
    assert stored() == [(timedelta(0), 1, money("1")), (MINUTE, 1, money("2")), (120 * MINUTE, 1, money("3"))]
    topic.send(message(5, 10), message(-86_400, 5))  # two hours and a day late
    query = amend()
    want = [(timedelta(days=-1), 1, money("5")), (timedelta(0), 2, money("11")), (MINUTE, 1, money("2")), (120 * MINUTE, 1, money("3"))]
    assert stored() == want
    sink = sinks.amending_sink(lambda s: jobs.minutes_by_day(s, path), minute_partials, add_partials)
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", query.id)
    try:
        sink(accepted(decode(spark.createDataFrame([(message(5, 10),)], "value string"))), 2)  # the last batch once more
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert stored() == want


def test_minutes_are_the_same_before_and_after_compaction(spark, topic, tmp_path):
    path = str(tmp_path / "partials")
    for n in range(6):
        topic.send(message(n * 50, n), message(n * 50 + 86_400 * (n % 3), 1))
    counting(spark, topic, tmp_path).awaitTermination()
    before = every_minute(spark, path)
    assert jobs.compact_minutes(spark, path) == 6
    assert every_minute(spark, path) == before
    assert [name for name in os.listdir(path) if name.startswith("query_id=") and os.listdir(f"{path}/{name}")] == []
    read = jobs.read_minutes(spark, path).inputFiles()
    assert len(read) == 3 and all("/part=2026-01-0" in name for name in read)  # one file a day
    assert jobs.compact_minutes(spark, path) == 0
    topic.send(message(10, 5), message(200_000, 1))
    counting(spark, topic, tmp_path).awaitTermination()
    after = every_minute(spark, path)
    assert sum(n for _, n, _ in after) == sum(n for _, n, _ in before) + 2
    day_one = every_minute(spark, path, end=NOON.date())
    assert jobs.compact_minutes(spark, path) == 1
    assert every_minute(spark, path) == after
    assert every_minute(spark, path, end=NOON.date()) == day_one == [row for row in after if row[0] < timedelta(hours=12)]
    assert every_minute(spark, path, start=d("2026-01-02"), end=d("2026-01-02")) == [r for r in after if timedelta(hours=12) <= r[0] < timedelta(hours=36)]


def test_compaction_can_be_interrupted(spark, topic, tmp_path, monkeypatch):
    """Published, but the batches' folders are still there: they count once, and go with the next run."""
    path = str(tmp_path / "partials")
    for n in range(3):
        topic.send(message(n, 1))
    counting(spark, topic, tmp_path).awaitTermination()
    before = every_minute(spark, path)
    values = storage.partition_values

    def stopped(spark, folder, column):
        if column == "batch_id":
            raise OSError("the driver is gone")
        return values(spark, folder, column)

    with monkeypatch.context() as patched:
        patched.setattr(storage, "partition_values", stopped)
        with pytest.raises(OSError):
            jobs.compact_minutes(spark, path)
    assert every_minute(spark, path) == before
    assert jobs.compact_minutes(spark, path) == 0
    assert every_minute(spark, path) == before


def test_old_days_expire(spark, topic, tmp_path):
    path = str(tmp_path / "partials")
    topic.send(message(0, 1), message(86_400, 1), message(2 * 86_400, 1))
    counting(spark, topic, tmp_path).awaitTermination()
    jobs.compact_minutes(spark, path)
    assert jobs.expire_minutes(spark, path, d("2026-01-03"), days=1) == [d("2026-01-01")]
    assert [w for w, _, _ in every_minute(spark, path)] == [timedelta(days=1), timedelta(days=2)]


def test_each_sink_gets_each_batch_once(spark, topic, tmp_path):
    got, failures = {"a": [], "b": [], "c": []}, []

    def taking(name):
        return lambda batch, number: got[name].append((number, batch.count()))

    def failing(batch, number):
        if number == 1 and len(failures) < 2:
            failures.append(number)
            raise OSError("not now")
        taking("b")(batch, number)

    def start():
        return sinks.start(accepted(decode(topic.stream())), [taking("a"), failing, taking("c")], str(tmp_path / "checkpoint"), available_now=True)

    for n in range(3):
        topic.send(*[message(n * 10 + i, 1) for i in range(n + 1)])
    for _ in range(2):
        with pytest.raises(PySparkException):
            start().awaitTermination()
    start().awaitTermination()
    assert got == {name: [(0, 1), (1, 2), (2, 3)] for name in "abc"}
    [notes] = os.listdir(tmp_path / "checkpoint" / "delivered")
    assert os.listdir(tmp_path / "checkpoint" / "delivered" / notes) == ["2"]
