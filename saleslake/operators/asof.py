"""As-of join: each row with the version of its key that began last before it, by sorting instead of comparing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleslake.operators.joins import BROADCAST_LIMIT, hot_values, lookup_join, salt_counts

# Up to this many versions of each key, every version is compared with a row at less cost than sorting the rows has.
FEW_VERSIONS = 8


def asof_join(
    rows: DataFrame,
    versions: DataFrame,
    key: str,
    on: str,
    start: str,
    end: str | None,
    values: Sequence[str],
    spread_on: Sequence[str],
    hot: Mapping[str, float],
) -> DataFrame:
    """All `rows` with `values` of the version of `key` that began last, on or before `on`, and has not ended by then.

    Rows and starts of versions share one order per key, in which the last version seen is carried forward: a key with v versions
    and n rows costs v + n and a sort, where a join with the interval as a condition compares v x n. A null `end` is open, an `end` before
    `on` gives nulls, as do rows with a null key, a null `on`, or no version. Versions of a key must not overlap nor begin
    together; with overlapping ones the one that began last counts. `values` must be other names than those of `rows`.

    Rows of a hot key, and those without a key, are dealt to many groups by a hash of `spread_on`; the hot key's versions are
    repeated in each, so no task sorts the rows of a key that holds a third of them all. A group's rows are
    sorted on disk where they do not fit.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = F.when(F.col(key).isNull(), F.lit(partitions)).otherwise(salt_counts(F.col(key), hot, partitions))
    salt = F.pmod(F.xxhash64(*spread_on), salts).cast("int")
    version = F.struct(F.col(end).alias("end") if end else F.lit(None).alias("end"), F.struct(*values).alias("values"))
    asking = rows.select(F.col(key).alias("_key"), salt.alias("_salt"), F.col(on).alias("_at"), F.lit(True).alias("_asks"), F.struct("*").alias("_row"))
    copies = F.explode(F.sequence(F.lit(0), salt_counts(F.col(key), hot, partitions) - 1)) if hot else F.lit(0)
    known = versions.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
        F.col(key).alias("_key"), copies.alias("_salt"), F.col(start).alias("_at"), F.lit(False).alias("_asks"), version.alias("_version")
    )
    # A version that begins at the same time as a row counts for it, so it comes first.
    so_far = Window.partitionBy("_key", "_salt").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        asking.unionByName(known, allowMissingColumns=True)
        .withColumn("_found", F.last("_version", ignorenulls=True).over(so_far))
        .where("_asks")
    )
    lasts = F.col("_found.end").isNull() | (F.col("_found.end") >= F.col("_at"))
    valid = lasts & F.col("_at").isNotNull() & F.col("_key").isNotNull()
    return found.select("_row.*", *(F.when(valid, F.col(f"_found.values.{v}")).alias(v) for v in values))


def most_versions(versions: DataFrame, key: str) -> int:
    """How many versions the key with most of them has."""
    return versions.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def version_lookup(
    rows: DataFrame,
    versions: DataFrame,
    key: str,
    on: str,
    start: str,
    end: str,
    values: Sequence[str],
    spread_on: Sequence[str],
    hot_from: DataFrame | None = None,
    broadcast_limit: int = BROADCAST_LIMIT,
    few: int = FEW_VERSIONS,
    most: int | None = None,
) -> DataFrame:
    """`asof_join` where some key has more than `few` versions; else a join that compares the few.

    Both give the same rows. With few versions a side that can be broadcast saves the shuffle of `rows`.
    `most` says how many versions a key has at most, where that is known.
    """
    if (most_versions(versions, key) if most is None else most) > few:
        hot = hot_values((rows if hot_from is None else hot_from).select(key), key)
        return asof_join(rows, versions, key, on, start, end, values, spread_on, hot)
    begins = F.col(on) >= F.col(start)
    lasts = F.col(end).isNull() | (F.col(on) <= F.col(end))
    joined = lookup_join(
        rows, versions.select(key, start, end, *values), key, "left", spread_on, residual=begins & lasts, hot_from=hot_from, broadcast_limit=broadcast_limit
    )
    return joined.drop(start, end)
