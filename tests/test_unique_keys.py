"""Keys that collide are settled: unique, independent of partitioning, and the same on replay."""

import random
from datetime import datetime, timezone

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from saleslake.functions.keys import surrogate_key
from saleslake.operators.dimensions import empty_dimension, refresh_products
from saleslake.operators.unique_keys import NoKeyLeft, narrow, salted_key, settled, with_unique_keys

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def newcomers(spark, ids, partitions=3):
    return spark.createDataFrame([(i,) for i in ids], "natural string").repartition(partitions)


def keys(frame):
    return {r["natural"]: r["key"] for r in frame.collect()}


def nothing(spark):
    return spark.createDataFrame([], "key long")


def test_without_collisions_keys_are_the_plain_hashes(spark):
    ids = [f"P{i}" for i in range(200)]
    found = settled(newcomers(spark, ids), nothing(spark))
    plain = spark.createDataFrame([(i,) for i in ids], "natural string").select("natural", surrogate_key(F.col("natural")).alias("key"))
    assert keys(found) == keys(plain)
    assert found.where("attempt > 0").isEmpty()


def by_hand(spark, ids, taken, values):
    """The same by a loop over rows, with keys of all attempts looked up."""
    hashes = spark.createDataFrame([(i, a) for i in ids for a in range(40)], "natural string, attempt int")
    table = {(r["natural"], r["attempt"]): r["key"] for r in hashes.withColumn("key", narrow(values)(F.col("natural"), F.col("attempt"))).collect()}
    attempt = dict.fromkeys(ids, 0)
    while True:
        held = {}
        for i in sorted(ids, key=lambda i: (attempt[i], i)):
            held.setdefault(table[i, attempt[i]], []).append(i)
        again = [i for key, members in held.items() for n, i in enumerate(members) if n or key in taken]
        if not again:
            return {i: table[i, attempt[i]] for i in ids}
        for i in again:
            attempt[i] += 1


@pytest.mark.parametrize("partitions", [1, 5])
def test_many_collisions(spark, partitions):
    rng = random.Random(2)
    ids = [f"P{i}" for i in rng.sample(range(1000), 60)]
    taken = rng.sample(range(120), 20)
    found = keys(settled(newcomers(spark, ids, partitions), spark.createDataFrame([(k,) for k in taken], "key long"), narrow(120)))
    assert len(set(found.values())) == 60 and not set(found.values()) & set(taken)
    assert found == by_hand(spark, ids, set(taken), 120)


def test_too_few_values(spark):
    with pytest.raises(NoKeyLeft):
        settled(newcomers(spark, ["a", "b", "c"]), nothing(spark), narrow(2))


def test_stored_rows_keep_their_keys(spark):
    shape = "product_id string, product_name string, category string, price decimal(27,9)"
    extract = lambda ids: spark.createDataFrame([(f"P{i}", "n", "c", None) for i in ids], shape)
    dim = empty_dimension(spark, "dim_product")
    seen = {}
    for ids in (range(0, 40, 2), range(40), range(20), range(60)):
        dim = spark.createDataFrame(refresh_products(dim, extract(ids), NOON, narrow(90)).collect(), dim.schema)
        now = dict(rows_of(dim, "product_id", "product_key"))
        assert seen.items() <= now.items() and len(set(now.values())) == len(now)
        seen = now
    assert len(seen) == 60


def test_sources_without_newcomers_are_left_as_they_are(spark):
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "id string, key long")
    source = spark.createDataFrame([("a", 7)], "id string, key long")
    assert rows_of(with_unique_keys(dim, source, "id", "key", salted_key)) == [("a", 7)]
    assert with_unique_keys(dim, source.limit(0), "id", "key").isEmpty()
