"""Key lookups that stay balanced when one key, or the null key, holds much of the data."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# A side is broadcast only if its measured bytes stay below this.
BROADCAST_LIMIT = 64 * 1024 * 1024

# Slices of that size that one list of keys may have, so that what is broadcast for it stays bounded.
SLICES = 4

# Bits that the keys of a long list are marked by at most, 32 MiB, how many of them a key has for itself, and how they are cut.
MARK_BITS = 2**28
_BITS_A_KEY = 16
_BLOCK_BITS, _WORD_BITS = 1024, 64

# A list of more bytes is marked where a few rows of other keys do no harm: a hash table takes several times the bytes of its keys, on the driver too.
MARKED_FROM = BROADCAST_LIMIT // 4

# A key counts as hot from this share of the rows on, so there are at most a thousand of them. Keys below
# it make partitions that adaptive execution can still split.
HOT_SHARE = 0.001
_SKETCH_ITEMS = 20_000


def measured_bytes(rows: DataFrame) -> int:
    """Size of the column values, by one aggregate over the rows (no estimate from file sizes)."""
    fixed = 0
    variable = []
    for field in rows.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            variable.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)))
            fixed += 8
        else:
            fixed += 16
    width = F.lit(fixed).cast("long")
    for size in variable:
        width = width + size
    return rows.agg(F.coalesce(F.sum(width), F.lit(0).cast("long")).alias("bytes")).first()["bytes"]


def hot_values(rows: DataFrame, key: str) -> dict[str, float]:
    """Values of `key` with at least `HOT_SHARE` of the rows, and their share.

    One pass with a sketch of fixed size. Its counts are approximate, which is enough: they only decide
    how a join is spread, never what it returns.
    """
    most = round(1 / HOT_SHARE)
    found = (
        rows.where(F.col(key).isNotNull())
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"approx_top_k(`{key}`, {most}, {_SKETCH_ITEMS})").alias("top"),
        )
        .first()
    )
    shares = {entry["item"]: entry["count"] / found["n"] for entry in found["top"] or []}
    return {value: share for value, share in shares.items() if share >= HOT_SHARE}


def salt_counts(key: Column, hot: Mapping[str, float], partitions: int) -> Column:
    """Number of salts for a key: about twice the partitions its share would fill, else one."""
    tiers: dict[int, list[str]] = {}
    for value, share in hot.items():
        wanted = min(partitions, 2 ** math.ceil(math.log2(max(2.0, 2 * share * partitions))))
        tiers.setdefault(wanted, []).append(value)
    salts = F.lit(1)
    for count, values in tiers.items():
        salts = F.when(key.isin(values), F.lit(count)).otherwise(salts)
    return salts


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_on: Sequence[str],
    hot: Mapping[str, float],
    residual: Column | None = None,
) -> DataFrame:
    """Equi-join on `key` (plus `residual`) in which hot and null keys of `left` use many partitions.

    Left rows with a hot key get a salt computed from `spread_on`; the matching right rows, which are
    few, are repeated once per salt. Null keys match nothing, so they only need spreading. A salt
    computed from row values (not `rand`) keeps the result the same when a lost task is rerun.
    Fits inner, left, left_semi and left_anti joins.
    """
    right = right.withColumnRenamed(key, "_lookup")
    match = F.col(key) == F.col("_lookup")
    keeps_nulls = how in ("left", "left_anti")
    if hot or keeps_nulls:
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = salt_counts(F.col(key), hot, partitions)
        if keeps_nulls:
            salts = F.when(F.col(key).isNull(), F.lit(partitions)).otherwise(salts)
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), salts).cast("int"))
        copies = F.sequence(F.lit(0), salt_counts(F.col("_lookup"), hot, partitions) - 1)
        right = right.withColumn("_copy", F.explode(copies) if hot else F.lit(0))
        match = match & (F.col("_salt") == F.col("_copy"))
    if residual is not None:
        match = match & residual
    return left.join(right, match, how).drop("_lookup", "_salt", "_copy")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_on: Sequence[str],
    residual: Column | None = None,
    hot_from: DataFrame | None = None,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Join `left` to a lookup side: broadcast if its measured size allows, else salted shuffle join.

    `hot_from` names a cheaper frame with the same key distribution to look for hot keys in.
    """
    if measured_bytes(right) <= broadcast_limit:
        right = right.withColumnRenamed(key, "_lookup")
        match = F.col(key) == F.col("_lookup")
        if residual is not None:
            match = match & residual
        return left.join(F.broadcast(right), match, how).drop("_lookup")
    hot = hot_values((left if hot_from is None else hot_from).select(key), key)
    return salted_join(left, right, key, how, spread_on, hot, residual)


def sliced_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_on: Sequence[str],
    most: int = SLICES * BROADCAST_LIMIT,
    slice_bytes: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Semi or anti join of `left` to a list of keys that may be too long for one broadcast.

    Up to `most` bytes it is broadcast in slices by the hash of the key. Each slice meets just the rows whose keys belong to it, so
    `left` is read once a slice, which costs less than to shuffle it where few rows are found. A longer list is shuffled.
    """
    size = measured_bytes(right)
    if size > most:
        return lookup_join(left, right, key, how, spread_on, broadcast_limit=0)
    slices = max(1, -(-size // slice_bytes))
    of_slice = F.pmod(F.xxhash64(key), F.lit(slices))
    joined = None
    for i in range(slices):
        rows, keys = (left, right) if slices == 1 else (left.where(of_slice == i), right.where(of_slice == i))
        part = rows.join(F.broadcast(keys.withColumnRenamed(key, "_lookup")), F.col(key) == F.col("_lookup"), how)
        joined = part if joined is None else joined.unionByName(part)
    return joined


def marked(left: DataFrame, keys: DataFrame, key: str, most_bits: int = MARK_BITS) -> DataFrame:
    """Rows of `left` whose key is in the list `keys`, and some of other keys; of each key all rows or none. Null keys match nothing.

    A Bloom filter: a key sets three bits of a block that its hash names, and only the blocks are broadcast. That is 2 bytes a key, and no more
    than `most_bits` for a list of any length, where a hash table of keys would take a hundred bytes for each of them on the driver and
    on every executor. Of the other keys 0.5% come along as long as there are 16 bits for each key, 2% of them with 8 and 15% with 4.
    """
    listed = keys.where(F.col(key).isNotNull())
    bits = min(most_bits, 2 ** math.ceil(math.log2(max(_BITS_A_KEY * listed.count(), _BLOCK_BITS))))
    hashed = F.xxhash64(key)
    # The lowest bits name the block, higher ones the places in it.
    block = F.pmod(hashed, F.lit(max(1, bits // _BLOCK_BITS)))
    places = [F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit(_BLOCK_BITS - 1)).cast("int") for shift in (28, 40, 52)]

    def word(place: Column) -> Column:
        return F.shiftright(place, int(math.log2(_WORD_BITS)))

    def bit(place: Column) -> Column:
        return place.bitwiseAND(F.lit(_WORD_BITS - 1))

    def set_in(i: int) -> Column:
        """The bits that a key sets in word `i` of its block."""
        each = [F.when(word(F.col(f"_p{n}")) == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(f"_p{n}")))).otherwise(F.lit(0).cast("long")) for n in range(len(places))]
        return F.bit_or(reduce(Column.bitwiseOR, each))

    # Dealt by block first, so that keys are shuffled and not blocks of every task.
    dealt = listed.select(block.alias("_block"), *(p.alias(f"_p{n}") for n, p in enumerate(places))).repartition("_block")
    blocks = dealt.groupBy("_block").agg(F.array(*map(set_in, range(_BLOCK_BITS // _WORD_BITS))).alias("_words"))
    has_all = reduce(Column.__and__, (F.getbit(F.get("_words", word(p)), bit(p)) == 1 for p in places))
    return left.join(F.broadcast(blocks), (block == F.col("_block")) & F.col(key).isNotNull() & has_all, "left_semi")
