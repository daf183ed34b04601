"""Exact dedup: a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import WHITE_SPACE, row_key, stored, without

# Runs that one node of the tree merges, and digest ranges each node is cut into.
FAN_IN = 16
RANGES = 1024

_KEY = ["node", "range", "digest", "check"]


def _runs(docs: DataFrame) -> DataFrame:
    """One row per document: its digest, a second hash that verifies it, and the run (input partition) it is in."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, WHITE_SPACE, "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.spark_partition_id().alias("node"),
        F.monotonically_increasing_id().alias("row"),
        row_key().alias("key"),
        F.char_length(text).alias("n_chars"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
        F.xxhash64(bare).alias("check"),
    ).withColumn("range", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(RANGES)))


def _merged(runs: DataFrame) -> DataFrame:
    """One level: runs are sent to their node's range, merged in order, and equal digests keep their best row.

    Partitioned by (node, range) and sorted, the rows are aggregated as they stream by, without another shuffle.
    """
    placed = runs.repartition("node", "range").sortWithinPartitions(*_KEY)
    return placed.groupBy(*_KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def keepers(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, row, key, keep_id, keep_row, keep_key, group_size, text_sha256.

    Texts are equal when identical without white space; a null text is empty. Of equal texts the row with the most
    code points stays, then the smallest doc_id (a null id last), then the first row, so exactly one row of a
    repeated row stays. Digests that agree while the second hash differs are kept apart. An empty table gives no
    rows; columns other than doc_id and text are ignored, whatever their names.

    Level 0 reduces each input partition to a run of distinct digests. In each further round the runs of `fan_in`
    nodes meet in one, range by range, until one node is left; a digest with any number of copies is at most
    one row of each run. The winners go back to the rows by way of the runs, so copies stay spread over them.
    """
    rows = stored(_runs(docs), "digests")
    # Order of preference, smallest first.
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "key")
    level0 = stored(
        rows.groupBy(*_KEY).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size")),
        "runs",
    )
    nodes = (level0.agg(F.max("node")).first()[0] or 0) + 1
    merged = level0
    while nodes > 1:
        merged = _merged(merged.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")))
        nodes = -(-nodes // fan_in)
    winners = merged.select(
        "digest",
        "check",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.row").alias("keep_row"),
        F.col("best.key").alias("keep_key"),
        F.col("size").alias("group_size"),
    )
    by_run = level0.select("node", "digest", "check").join(winners, ["digest", "check"])
    return rows.join(by_run, ["node", "digest", "check"]).select(
        "doc_id", "row", "key", "keep_id", "keep_row", "keep_key", "group_size", F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """`keepers` in the form of the query: doc_id, keep_id, group_size, kept, text_sha256."""
    found = keepers(docs)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the one that `keepers` names.

    A null text is empty; a null doc_id comes after all others. Rows that repeat id and text count as one document, and one
    of them stays. An empty table stays empty. Texts are not shuffled: the keys of what goes are.
    """
    found = keepers(docs).where(F.col("row") != F.col("keep_row"))
    same = (F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    copies = stored(found.select("doc_id", "key", same.alias("repeats")), "copies")
    gone = stored(copies.where("not repeats").select("doc_id", "key").distinct(), "gone")
    repeated = stored(copies.where("repeats").select("doc_id", "key").distinct(), "repeated")
    return without(docs, gone, repeated)
