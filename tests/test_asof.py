"""The as-of join gives what comparing every version with every row gives."""

import random
import time
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from saleslake.operators.asof import asof_join, most_versions, version_lookup

SHAPE = "key string, lo int, hi int, value string"


def sides(seed, rows=2000):
    rng = random.Random(seed)
    versions = []
    for key in ["hot", *(f"k{i}" for i in range(40))]:
        starts = sorted(rng.sample(range(500), rng.randint(0, 60)))
        for lo, following in zip(starts, [*starts, None][1:], strict=True):
            hi = None if following is None else following - 1
            if rng.random() < 0.3:
                hi = min(lo + rng.randint(0, 5), 10**6 if hi is None else hi)
            versions.append((key, lo, hi, f"{key}@{lo}"))
    versions.append((None, 3, None, "no key"))
    keys = ["hot"] * 30 + [None] * 20 + [f"k{i}" for i in range(45)]
    left = [(i, rng.choice(keys), rng.choice([None, *range(-5, 510)])) for i in range(rows)]
    return left, versions


def compared(left, versions):
    out = []
    for i, key, at in left:
        found = [v for k, lo, hi, v in versions if None not in (k, at) and k == key and lo <= at and (hi is None or at <= hi)]
        assert len(found) <= 1
        out.append((i, key, at, found[0] if found else None))
    return Counter(out)


def frames(spark, left, versions):
    return spark.createDataFrame(left, "row_id long, key string, at int"), spark.createDataFrame(versions, SHAPE)


def result(frame):
    assert frame.columns == ["row_id", "key", "at", "value"]
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [{}, {"hot": 0.3, "k7": 0.01}])
def test_against_comparison(spark, seed, hot):
    left, versions = sides(seed)
    rows, known = frames(spark, left, versions)
    joined = asof_join(rows, known, "key", "at", "lo", "hi", ["value"], ["row_id"], hot)
    assert result(joined) == compared(left, versions)
    open_ended = asof_join(rows, known, "key", "at", "lo", None, ["value"], ["row_id"], hot)
    assert sum(1 for r in open_ended.collect() if r["value"]) > sum(1 for r in joined.collect() if r["value"])


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("few", [0, 8, 1000])
def test_the_lookup_gives_the_same_either_way(spark, few, limit):
    left, versions = sides(3, 800)
    rows, known = frames(spark, left, versions)
    found = version_lookup(rows, known, "key", "at", "lo", "hi", ["value"], ["row_id"], broadcast_limit=limit, few=few)
    assert result(found) == compared(left, versions)
    assert ("Window" in plan_of(found)) == (few < most_versions(known, "key"))


def test_empty_sides(spark):
    left, versions = sides(4, 20)
    rows, known = frames(spark, left, versions)
    for few in (0, 8):
        nothing = version_lookup(rows, known.limit(0), "key", "at", "lo", "hi", ["value"], ["row_id"], few=few)
        assert result(nothing) == compared(left, [])
        assert version_lookup(rows.limit(0), known, "key", "at", "lo", "hi", ["value"], ["row_id"], few=few).collect() == []
    assert result(asof_join(rows, known.limit(0), "key", "at", "lo", "hi", ["value"], ["row_id"], {"hot": 0.5})) == compared(left, [])


def test_a_key_with_a_long_history(spark):
    """5,000 versions and 50,000 rows of one key: the plan compares no intervals, and dealt rows are in many groups."""
    rows = spark.range(60_000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 50_000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), (F.col("id") * 7919 % 50_000).cast("int").alias("at")
    )
    hot = spark.range(5000).select(F.lit("hot").alias("key"), (F.col("id") * 10).cast("int").alias("lo"), (F.col("id") * 10 + 8).cast("int").alias("hi"), F.col("id").cast("string").alias("value"))
    others = spark.range(50).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit(0).alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit("all").alias("value"))
    versions = hot.unionByName(others)
    began = time.monotonic()
    found = version_lookup(rows, versions, "key", "at", "lo", "hi", ["value"], ["row_id"])
    plan = plan_of(found)
    assert "Window" in plan and "Join" not in plan
    want = F.when(F.col("key") != "hot", F.lit("all")).when(F.col("at") % 10 < 9, F.floor(F.col("at") / 10).cast("string"))
    assert found.where(~F.col("value").eqNullSafe(want)).count() == 0
    assert found.count() == 60_000
    assert time.monotonic() - began < 60
