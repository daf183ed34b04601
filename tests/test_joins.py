"""The lookup joins give the same rows whichever way they run, also with hot and null keys."""

from collections import Counter

import pytest
from conftest import final_plan_of, plan_of
from pyspark.sql import functions as F

from saleslake.operators.joins import hot_values, lookup_join, marked, measured_bytes, salt_counts, salted_join, sliced_lookup

LEFT = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 50}", i % 10) for i in range(3000)]
# Two intervals per key, and keys that no left row has; `k7` is missing on this side.
RIGHT = [(k, lo, lo + 4, f"{k}-{lo}") for k in ["hot", "spare", *(f"k{i}" for i in range(50) if i != 7)] for lo in (0, 5)]


def brute_force(how):
    out = []
    for row_id, key, at in LEFT:
        matches = [name for k, lo, hi, name in RIGHT if k == key and lo <= at <= hi]
        if how == "left_semi":
            out += [(row_id, key, at)] if matches else []
        elif how == "left_anti":
            out += [] if matches else [(row_id, key, at)]
        else:
            out += [(row_id, key, at, m) for m in matches]
            if how == "left" and not matches:
                out.append((row_id, key, at, None))
    return Counter(out)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame(LEFT, "row_id long, key string, at int")
    right = spark.createDataFrame(RIGHT, "key string, lo int, hi int, name string")
    return left, right


def result(frame, how):
    columns = ["row_id", "key", "at"] + (["name"] if how in ("inner", "left") else [])
    return Counter(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [0, 10**9])
def test_lookup_join_matches_brute_force(sides, how, limit):
    left, right = sides
    joined = lookup_join(
        left, right, "key", how, spread_on=["row_id"], residual=F.col("at").between(F.col("lo"), F.col("hi")),
        broadcast_limit=limit,
    )
    assert result(joined, how) == brute_force(how)


def test_size_check_decides_between_broadcast_and_salting(spark, sides):
    left, right = sides
    small = lookup_join(left, right, "key", "left", spread_on=["row_id"])
    assert "BroadcastHashJoin" in plan_of(small)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = lookup_join(left, right, "key", "left", spread_on=["row_id"], broadcast_limit=10)
        plan = plan_of(large)
        assert "SortMergeJoin" in plan and "_salt" in plan
        assert "BroadcastHashJoin" not in plan
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_and_null_keys_are_spread(spark):
    left = spark.range(8000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).alias("key")
    )
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "key string, v int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, "key", "left", ["row_id"], hot={"hot": 0.5})
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 8000
    assert max(sizes) < 8000 * 0.4


def test_hot_values_are_the_frequent_ones(spark):
    rows = spark.range(10000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS key")
    assert hot_values(rows, "key") == {"hot": pytest.approx(1 / 3, rel=0.01)}
    assert hot_values(rows.where("key <> 'hot'"), "key") == {}
    assert hot_values(rows.limit(0), "key") == {}


def test_salts_follow_the_share_of_a_key(spark):
    keys = spark.createDataFrame([("huge",), ("big",), ("cold",)], "key string")
    counted = keys.select("key", salt_counts(F.col("key"), {"huge": 0.4, "big": 0.002}, 2000).alias("salts"))
    assert dict(tuple(r) for r in counted.collect()) == {"huge": 2000, "big": 8, "cold": 1}


def test_measured_bytes_counts_string_lengths(spark):
    rows = spark.createDataFrame([("abc", 1), (None, 2)], "s string, n long")
    assert measured_bytes(rows) == 3 + 2 * (8 + 16)
    assert measured_bytes(rows.limit(0)) == 0


def test_plain_equi_join_without_hot_keys(sides):
    left, right = sides
    joined = salted_join(left, right, "key", "inner", ["row_id"], hot={})
    assert "_salt" not in final_plan_of(joined)


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
@pytest.mark.parametrize(("most", "slice_bytes"), [(10_000, 10_000), (10_000, 100), (10, 10)])
def test_sliced_lookup_matches_brute_force(spark, how, most, slice_bytes):
    """A list of keys in one broadcast, in several, and shuffled; null keys match nothing."""
    left = spark.createDataFrame(LEFT, "row_id int, key string, at int")
    keys = sorted({k for k, *_ in RIGHT})
    right = spark.createDataFrame([(k,) for k in keys], "key string")
    joined = sliced_lookup(left, right, "key", how, ["row_id"], most, slice_bytes)
    plan = plan_of(joined)
    assert ("BroadcastHashJoin" in plan) == (most > 10)
    assert (plan.count("BroadcastHashJoin") > 1) == (slice_bytes == 100)
    wanted = [row for row in LEFT if (row[1] in keys) == (how == "left_semi")]
    assert Counter(map(tuple, joined.collect())) == Counter(wanted)


def test_marked_rows_hold_all_of_the_list_and_few_others(spark):
    """Bits are broadcast, not keys, and no more of them than asked for; of each key all rows come or none."""
    rows = spark.range(40_000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), (F.col("id") % 20_000).cast("string"))).alias("key"), "id")
    wanted = spark.range(0, 20_000, 10).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).unionByName(rows.limit(1).select("key"))
    for most_bits, others in ((2**28, 0.02), (2**14, 0.25), (1024, 1.0)):
        found = marked(rows, wanted, "key", most_bits)
        assert found.columns == rows.columns
        counts = dict(map(tuple, found.groupBy("key").count().collect()))
        assert None not in counts and counts.keys() >= {f"k{n}" for n in range(0, 20_000, 10)}
        assert {n for key, n in counts.items() if key != "k0"} == {2}
        assert len(counts) <= 2000 + others * 18_000
    assert marked(rows, wanted.limit(0), "key").isEmpty()
