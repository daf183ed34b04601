"""Session settings the jobs are written for."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import wraps

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Adaptive execution sizes shuffles at run time, splits skewed join partitions and turns a join into
# a broadcast once a side is seen to be small. UTC keeps minute windows and dates the same everywhere.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app_name: str = "saleslake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with `SETTINGS`; `extra` (dots written as double underscores) overrides or adds."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """Set, on a session started elsewhere, the time zone results depend on and the listing parallelism.

    Folders of a partitioned table are listed by Spark tasks, by default one per folder, which for many
    small folders costs far more than the listing itself.
    """
    spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])
    listers = max(16, 2 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(listers))


# What a task reads or gets from a shuffle at most, where it sorts rows that take ten times the memory they have on disk.
SORTED_BYTES = "32m"


def sort_in_memory(spark: SparkSession) -> None:
    """Let no task read or get more than `SORTED_BYTES` where input can be cut; smaller limits that are set stay."""
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if _bytes(spark.conf.get(key)) > _bytes(SORTED_BYTES):
            spark.conf.set(key, SORTED_BYTES)


def _bytes(size: str) -> int:
    digits, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(digits) * 1024 ** " kmgtp".index(unit[0] if unit and unit[0] != "b" else " ")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Run a block with another value of a setting that affects only how jobs run, not their results."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drops_shuffles(job: Callable) -> Callable:
    """A job of several writes, given the session first, whose shuffle files go as each write or read in it ends.

    Otherwise they stay until the driver happens to collect its garbage, so that the shuffles of all steps of a load can lie on the
    executors' disks together. A frame that is made within must not be run twice itself; what is read again has to be stored.
    """

    @wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        with setting(spark, SHUFFLE_CLEANUP, "true"):
            return job(spark, *args, **kwargs)

    return run


def together(spark: SparkSession, steps: Iterable[Callable[[], object]]) -> None:
    """Submit independent steps at the same time, so small jobs do not wait for each other."""
    steps = list(steps)
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]:
            done.result()
