"""What the operators share: reading tables, tables in the shared work folder, text forms."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleslake import storage
from saleslake.operators.joins import lookup_join

# The white space of the contracts: [\x20\x09-\x0D], which is also what bytes.split() splits at.
WHITE_SPACE = " \t\n\x0b\x0c\r"
# Lower-cases A-Z and no other character.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# Rows that Spark hands to a Python task at a time. Texts are long, so the usual 10,000 would be tens of megabytes on both sides.
ROWS_A_BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of what is handed to Python tasks; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Rows written to the shared work folder and read again, which cuts the lineage.

    The folder goes when the application ends; results that are still lazy may read it until then.
    """
    spark = rows.sparkSession
    path = storage.work_dir(spark, f"{name}-{uuid4().hex}")
    rows.write.parquet(path, compression=compression)
    storage.delete_at_exit(spark, path)
    table = spark.read.schema(rows.schema).parquet(path)
    table.stored_at = path
    return table


def free(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, before the application ends."""
    for table in tables:
        storage.delete(table.sparkSession, table.stored_at)


def row_key() -> Column:
    """A document's id and text as one number: texts that share an id are different documents, repeated rows are one."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_bytes())


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """`docs` without the documents in `gone` (doc_id, key), and with one row of each of those in `repeated` (doc_id, key).

    Only keys are shuffled or broadcast; of the texts only those of repeated rows are. Both are stored tables without repeats.
    """
    # The document's own columns travel in a struct, so that no name can clash.
    keyed = docs.select(F.struct("*").alias("doc"), row_key().alias("key"), F.col("doc_id").cast("long").alias("id"))
    same = F.col("id").eqNullSafe(F.col("doc_id"))

    def rows_of(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        return lookup_join(rows, found, "key", how, ["key"], residual=same)

    kept = rows_of(keyed, gone, "left_anti")
    if not repeated.isEmpty():
        of_key = Window.partitionBy("key", "id").orderBy(F.to_json("doc"))
        once = rows_of(kept, repeated, "left_semi").withColumn("nth", F.row_number().over(of_key)).where("nth = 1").drop("nth")
        kept = rows_of(kept, repeated, "left_anti").unionByName(once)
    return kept.select("doc.*")


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, null as the empty text: what Python tasks read without decoding."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def fold(remainders: int) -> Column:
    """crc32 of the decimal doc_id modulo `remainders`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(remainders))


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a task builds beside them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ranked(rows: DataFrame, key: str, n: str, order: list[str], late: Column | None = None, together: Column | None = None) -> DataFrame:
    """`rows` with `rank`: the place of a row among those of its key, gapless from 0, in some fixed order.

    Rows of a key with equal `together` (few of them) are ranked side by side, if `order` puts them so.

    `n` names a column with the number of rows of the key. These are ranked in about the square root of that many
    groups, whose sizes are then added up, so that a key with most of the rows is ranked by many tasks. Rows for which
    `late` is true come after all others of their key.
    """
    groups = F.greatest(F.lit(1), F.round(F.sqrt(n))).cast("int")
    part = F.pmod(F.xxhash64(*order) if together is None else F.xxhash64(together), groups)
    if late is not None:
        part = part + F.when(late, groups).otherwise(0)
    parted = stored(rows.withColumn("_part", part.cast("int")), "parted")
    sizes = parted.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_key", "_of", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_part").orderBy(*order)
    return (
        parted.withColumn("_nth", F.row_number().over(within))
        .join(starts, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")))
        .withColumn("rank", F.col("_start") + F.col("_nth") - 1)
        .select(*rows.columns, "rank")
    )
