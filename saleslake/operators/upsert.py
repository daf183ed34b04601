"""Insert-or-update of keyed rows as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.operators.joins import lookup_join


class DuplicateKeys(ValueError):
    """A merge source has several rows for one key, so there is no single new value."""


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def require_unique(rows: DataFrame, keys: Sequence[str], what: str) -> None:
    if not duplicate_keys(rows, keys).isEmpty():
        raise DuplicateKeys(f"{what} has several rows for one {', '.join(keys)}")


def _replaced(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """All of `source`, and the rows of `target` whose key it lacks; those without a key match nothing."""
    require_unique(source, [key], "merge source")
    lacking = target.where(F.col(key).isNotNull()).select(key).join(source.select(key), key, "left_anti")
    others = [c for c in target.columns if c != key]
    staying = lookup_join(target, lacking.distinct(), key, "left_semi", others or [key])
    return staying.unionByName(target.where(F.col(key).isNull())).unionByName(source)


def upsert(
    target: DataFrame, source: DataFrame, key: str, insert_only: Sequence[str] = (), version: str | None = None
) -> DataFrame:
    """`target` after merging `source`, which must be unique on `key`; else the job that reads the result fails.

    A matched row takes the source's values except in `insert_only` columns, which a row gets once when
    it first appears. With `version` it does so only if the source's value of that column is not older,
    so the replay of an old load cannot undo a newer one. Unmatched target rows stay; unmatched source
    rows are added. Both sides are unique on `key`, so the one shuffle this costs is balanced.

    Without these two a source row simply stands for the target's, so only keys are shuffled, and `source` is read several times:
    store it first. A source that is not unique fails here then.
    """
    columns = target.columns
    if not insert_only and version is None:
        return _replaced(target, source.select(*columns), key)
    t = target.select(F.col(key), F.struct(*columns).alias("_t"))
    # Grouped by the key that the join partitions by anyway, so the rule costs no further shuffle.
    several = F.raise_error(F.concat(F.lit(f"merge source has several rows for {key} "), F.col(key).cast("string")))
    grouped = source.groupBy(key).agg(F.first(F.struct(*columns)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    s = grouped.select(F.col(key), F.when(F.col("_n") == 1, F.col("_s")).otherwise(several.cast(grouped.schema["_s"].dataType)).alias("_s"))
    in_target = F.col("_t").isNotNull()
    takes_source = F.col("_s").isNotNull()
    if version is not None:
        takes_source = takes_source & (~in_target | (F.col(f"_s.{version}") >= F.col(f"_t.{version}")))

    def merged(column: str):
        old, new = F.col(f"_t.{column}"), F.col(f"_s.{column}")
        if column in insert_only:
            return F.when(in_target, old).otherwise(new)
        return F.when(takes_source, new).otherwise(old)

    joined = t.join(s, key, "full_outer")
    return joined.select(*(F.col(key) if c == key else merged(c).alias(c) for c in columns))
