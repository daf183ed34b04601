"""What a load leaves on the disks while it runs: shuffles of steps that are over, and tables that are not read again, are gone."""

import re

from pyspark.sql import functions as F

from saleslake import storage
from saleslake.plans import fact, pipeline, queries
from saleslake.session import SHUFFLE_CLEANUP, drops_shuffles

SF = "/root/testdata/sf0.001"


def shuffles(spark):
    """Numbers of the shuffles that have files on the disks."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return set(re.findall(r"shuffle_(\d+)_\d+_0\.data", files))


def two_writes(spark, path):
    before = shuffles(spark)
    for n in range(2):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(f"{path}/{n}")
    return shuffles(spark) - before


def test_shuffles_of_steps_that_are_over_are_gone(spark, tmp_path):
    assert len(two_writes(spark, f"{tmp_path}/kept")) == 2
    assert drops_shuffles(two_writes)(spark, f"{tmp_path}/dropped") == set()
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert spark.read.parquet(f"{tmp_path}/dropped/1").agg(F.sum("count")).first()[0] == 1000


def test_days_of_a_large_first_load_are_written_from_stored_lines(spark, monkeypatch):
    """They were ranked, joined, dealt and written in one job, with the shuffles of all these steps on the disks at its end."""
    seen = []
    write = fact.write_fact

    def noted(rows, *args):
        left = shuffles(spark) - known
        seen.append(("Window" in rows._jdf.queryExecution().optimizedPlan().toString(), left))
        return write(rows, *args)

    monkeypatch.setattr(fact, "write_fact", noted)
    monkeypatch.setattr(pipeline, "LARGE_LOAD", 5000)
    t = queries.samples(spark, SF)
    rows = t.newest_items().count()
    known = shuffles(spark)
    assert queries.bootstrap_history(spark, SF).count() == rows
    assert seen == [(False, set())]


def test_daily_runs_drop_what_the_extracts_were_cut_out_of(spark, monkeypatch):
    """The newest lines and headers stayed until the application ended. Extracts hold all columns, compressed."""
    seen = []

    def run(spark, layout, on):
        seen.append((storage.exists(spark, f"{layout.root}/newest"), len(storage.matching(spark, f"{layout.daily_extract('transaction_items', on)}/*.csv.gz")) > 0))

    monkeypatch.setattr(queries, "run_day", run)
    monkeypatch.setattr(queries, "backfill", lambda *_: None)
    monkeypatch.setattr(queries, "read_fact", lambda *_: None)
    queries.daily_runs(spark, SF)
    assert seen == [(True, True), (True, True), (False, True), (False, True)]


def test_all_loads_drop_their_shuffles():
    loads = (pipeline.run_day, pipeline.backfill, pipeline.bootstrap, pipeline.load_sales, queries.star, queries.daily_runs, queries.fact_loaded_in_steps)
    assert all(hasattr(load, "__wrapped__") for load in loads)
