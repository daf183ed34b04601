"""Surrogate keys that collide: newcomers are hashed again with a salt until no two rows share a key.

Keys are hashes of natural keys, so that they need no counter and no order of loads. The stored dimension is the registry: a row keeps
the key that it got first, so a replay, or a load after a collision was settled, finds the same keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslake import storage
from saleslake.functions.keys import surrogate_key
from saleslake.operators.joins import lookup_join

Hashed = Callable[[Column, Column], Column]

# Two rows that collide by chance differ after the next hash; a hash that has too few values never gets that far.
MOST_ATTEMPTS = 64


class NoKeyLeft(RuntimeError):
    """So many attempts still collide that the hash cannot have enough values."""


def salted_key(natural: Column, attempt: Column) -> Column:
    """The surrogate key of a natural key, and other ones for the attempts after the first."""
    return F.when(attempt == 0, surrogate_key(natural)).otherwise(surrogate_key(natural, attempt.cast("string")))


def _colliding(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Natural keys of the rows (natural, attempt, key) that have to give way: to stored rows, or to the first row of their key."""
    first = Window.partitionBy("key").orderBy("attempt", "natural")
    later = rows.withColumn("nth", F.row_number().over(first)).where("nth > 1").select("natural")
    return later.unionByName(lookup_join(rows, taken, "key", "left_semi", ["natural"]).select("natural")).distinct()


def settled(newcomers: DataFrame, taken: DataFrame, hashed: Hashed = salted_key) -> DataFrame:
    """(natural, attempt, key) of the newcomers (natural, unique): keys that differ from each other and from those in `taken` (key).

    Of newcomers with one key, that with the fewest attempts keeps it, then the smallest natural key: the result does not depend on how
    the rows are partitioned. Without a collision, which is the rule, this is one pass over the newcomers and a join of their keys
    with the stored ones; each further round has only what collided to change.
    """
    zero = F.lit(0)
    rows = newcomers.select("natural", zero.alias("attempt"), hashed(F.col("natural"), zero).alias("key"))
    for _ in range(MOST_ATTEMPTS):
        again = _colliding(rows, taken)
        if again.isEmpty():
            return rows
        marked = rows.join(again.withColumn("again", F.lit(1)), "natural", "left")
        attempt = F.col("attempt") + F.coalesce("again", zero)
        key = F.when(F.col("again").isNull(), F.col("key")).otherwise(hashed(F.col("natural"), attempt))
        rows = _stored(marked.select("natural", attempt.alias("attempt"), key.alias("key")))
    raise NoKeyLeft(f"keys still collide after {MOST_ATTEMPTS} attempts")


def _stored(rows: DataFrame) -> DataFrame:
    """Rows written to the shared work folder and read again: a round does not work out the ones before it."""
    spark = rows.sparkSession
    path = storage.work_dir(spark, f"keys-{uuid4().hex}")
    rows.write.parquet(path)
    storage.delete_at_exit(spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def with_unique_keys(dim: DataFrame, source: DataFrame, natural: str, key: str, hashed: Hashed = salted_key) -> DataFrame:
    """`source` with a `key` for each `natural` key that none of the others and no other row of `dim` has.

    Rows that `dim` has keep its key, which `upsert` sees to; only the others are looked at.
    """
    known = dim.select(F.col(natural).alias("natural"))
    newcomers = source.select(F.col(natural).alias("natural")).join(known, "natural", "left_anti").distinct()
    found = settled(newcomers, dim.select(F.col(key).alias("key")), hashed)
    if found.where("attempt > 0").isEmpty():
        return source
    again = found.where("attempt > 0").select(F.col("natural").alias(natural), F.col("key").alias("_settled"))
    return source.join(again, natural, "left").withColumn(key, F.coalesce("_settled", key)).select(*source.columns)


def narrow(values: int) -> Hashed:
    """A hash with just so many values, to see what happens when keys collide."""
    return partial(_narrow, values)


def _narrow(values: int, natural: Column, attempt: Column) -> Column:
    return F.pmod(salted_key(natural, attempt), F.lit(values))
