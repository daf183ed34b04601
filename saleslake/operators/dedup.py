"""Newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    rows: DataFrame,
    keys: Sequence[str],
    newest: str = "ingest_date",
    tiebreakers: Sequence[str] | None = None,
    by_hash: bool = False,
) -> DataFrame:
    """One row per key: the one with the greatest `newest`, ties settled by `tiebreakers` ascending.

    Without `tiebreakers` all remaining columns settle ties, so the choice never depends on the order
    in which tasks deliver rows. Filtering on the rank directly lets Spark keep one row per key in each
    input partition before the shuffle, so even a key with most of the rows sends few to its task.

    `by_hash` sorts by a hash of the keys first, which tells long ids that begin alike apart at less cost. The result is then not
    partitioned by the keys, which a join on them would make use of.
    """
    if tiebreakers is None:
        tiebreakers = sorted(c for c in rows.columns if c not in keys and c != newest)
    order = [F.col(newest).desc_nulls_last(), *(F.col(c).asc_nulls_first() for c in tiebreakers)]
    parts = [*keys]
    if by_hash:
        rows = rows.withColumn("_hash", F.xxhash64(*keys))
        parts = ["_hash", *keys]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank", "_hash")
