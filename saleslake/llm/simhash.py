"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints with at most r differing bits share a variant that differs from each in at most r/2 bits. Every
fingerprint emits all its variants within r/2 and fingerprints meet on equal variants. Any two that meet are within r
of each other, so linking each to the smallest one that it meets loses no link, whatever the size of a group.

`near_duplicates` names each document's group, `drop_near_duplicates` keeps one document of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import pieces_of, row_key, stored, text_bytes, without, words
from saleslake.llm.components import connected

BITS = 64
SEED = 42
# Variants are dealt out by their first bits, so a fingerprint goes to 16 buckets (five bits) rather than as 2,081 rows.
# There are more bits, and buckets, the more fingerprints there are.
LEAST_BITS, BUCKET_ROWS = 5, 8000
# Variants one step holds at a time; a larger set is split by its next bit.
VARIANTS_AT_ONCE = 500_000
_SHINGLES_AT_ONCE = 1 << 16


def shingles(found: list[bytes], width: int) -> Iterator[bytes]:
    """Runs of `width` words, repeats included; fewer words are one shingle, none are none."""
    if not found:
        return iter(())
    if len(found) < width:
        return iter((b" ".join(found),))
    return map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False))


def fingerprint(text: bytes, width: int) -> int:
    """As a signed number: bit j is 1 if it is set in over half of the shingles' hashes."""
    found = words(text)
    total = max(len(found) - width + 1, 1) if found else 0
    runs = shingles(found, width)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, total, _SHINGLES_AT_ONCE):
        n = min(_SHINGLES_AT_ONCE, total - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(next(runs), SEED) for _ in range(n)), "<u8", n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, fp) of every whole text; fp zero for a text without words, key the row's `row_key`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            found = pa.array([fingerprint(text.as_py(), width) for text in batch.column(2)], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), found], names=["doc_id", "key", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text_bytes().alias("text"))
    return source.mapInArrow(read, "doc_id long, key long, fp long")


@cache
def masks(bits: int, flips: int) -> np.ndarray:
    """All numbers of `bits` bits with at most `flips` ones."""
    return np.array([sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(bits), n)], np.uint64)


def lowest_linked(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For links among 0..n-1 the smallest number each can reach."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label
    return label


def meet(fps: np.ndarray, flips: np.ndarray, bits: int, at_once: int = VARIANTS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (positions in `fps`) between numbers that share a variant of their last `bits` bits.

    `flips` is how many bits each may still change. Links go from the first position that meets on a variant to the others.
    """
    work = [(np.arange(len(fps)), flips, bits)]
    while work:
        who, left, bits = work.pop()
        if len(who) < 2:
            continue
        sizes = {int(f): len(masks(bits, int(f))) for f in np.unique(left)}
        if bits and sum(int((left == f).sum()) * m for f, m in sizes.items()) > at_once:
            one = (fps[who] >> np.uint64(bits - 1)) & np.uint64(1)
            for side in (0, 1):
                rest = left - (one != side)
                work.append((who[rest >= 0], rest[rest >= 0], bits - 1))
            continue
        low = fps[who] & np.uint64((1 << bits) - 1)
        blocks = [(who[left == f], low[left == f][:, None] ^ masks(bits, f)[None, :]) for f in sizes]
        variants = np.sort(np.concatenate([v.ravel() for _, v in blocks]))
        shared = np.unique(variants[1:][variants[1:] == variants[:-1]])
        if not len(shared):
            continue
        at, owner = [], []
        for members, block in blocks:
            place = np.minimum(np.searchsorted(shared, block), len(shared) - 1)
            hit = shared[place] == block
            at.append(place[hit])
            owner.append(np.broadcast_to(members[:, None], block.shape)[hit])
        place, owners = np.concatenate(at), np.concatenate(owner)
        order = np.lexsort((owners, place))
        place, owners = place[order], owners[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        heads = np.repeat(owners[first], np.diff(np.append(first, len(owners))))
        yield heads, owners


def bucket_links(
    fps: np.ndarray, ids: np.ndarray, bucket: int, radius: int, bucket_bits: int, at_once: int = VARIANTS_AT_ONCE
) -> tuple[np.ndarray, np.ndarray]:
    """Links found among the fingerprints sent to one bucket: (id, smallest id it reaches here)."""
    order = np.argsort(ids, kind="stable")
    fps, ids = fps[order], ids[order]
    low_bits = BITS - bucket_bits
    flips = radius // 2 - np.bitwise_count((fps >> np.uint64(low_bits)) ^ np.uint64(bucket)).astype(np.int64)
    left, right = [], []
    for heads, others in meet(fps, flips, low_bits, at_once):
        pairs = np.unique(heads.astype(np.int64) * len(fps) + others)
        heads, others = pairs // len(fps), pairs % len(fps)
        near = (np.bitwise_count(fps[heads] ^ fps[others]) <= radius) & (heads != others)
        left.append(heads[near])
        right.append(others[near])
    if not left:
        return ids[:0], ids[:0]
    heads, others = np.concatenate(left), np.concatenate(right)
    label = lowest_linked(heads, others, len(fps))
    moved = label != np.arange(len(fps))
    return ids[moved], ids[label[moved]]


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that connect all of `classes` (fp, first) whose fingerprints differ in at most `radius` bits."""
    bucket_bits = min(BITS // 2, max(LEAST_BITS, (classes.count() // BUCKET_ROWS).bit_length()))

    def find(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        u, v = bucket_links(fps, rows.column("first").to_numpy(), key[0].as_py(), radius, bucket_bits)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    near = F.array(*(F.lit(int(m)) for m in masks(bucket_bits, radius // 2)))
    dealt = classes.select("fp", "first", F.explode(near).alias("mask")).select(
        "fp", "first", F.shiftrightunsigned("fp", BITS - bucket_bits).bitwiseXOR(F.col("mask")).cast("int").alias("bucket")
    )
    return dealt.groupBy("bucket").applyInArrow(find, "u long, v long")


def _check(radius: int) -> None:
    if radius % 2:
        raise ValueError("the radius must be even: each side takes half of it")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Of repeated rows each gets a row. A null
    doc_id is not an identifier: its row takes part if another row has the same fingerprint, and else links to nothing
    and gets a null component. An empty table gives no rows; further columns are ignored.
    """
    _check(radius)
    prints = stored(fingerprints(docs, width), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = connected(links(classes.where("first is not null"), radius))
    named = stored(
        classes.join(found, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("component", "first").alias("component_id")),
        "named",
    )
    # Two stored tables: the partition of a fingerprint that many documents share can be split at run time.
    return prints.join(named.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group stays, that with the smallest id, with all its columns.

    Groups are those of `near_duplicates`: fingerprints linked at `radius` or fewer differing bits, and what they reach.
    Null and empty texts have fingerprint zero and are linked like any other. Texts that share an id are documents of their
    own, rows that repeat id and text are one, of which one row stays. A null id comes after all others, so such a document
    goes if it is linked to one with an id; of equal ids the smallest hash of id and text stays. An empty table stays
    empty. Texts are not shuffled: the keys of what goes are.
    """
    _check(radius)
    prints = stored(fingerprints(docs, width), "prints")
    # A group is known by its smallest fingerprint, so that documents with one id but different texts are not taken for one.
    classes = stored(prints.select("fp", F.col("fp").alias("first")).distinct(), "classes")
    found = connected(links(classes, radius))
    groups = stored(classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("group")), "groups")
    # Equal rows are counted before they meet, and the partition of a fingerprint that many share can be split at run time.
    rows = stored(prints.groupBy("doc_id", "key", "fp").agg(F.count(F.lit(1)).alias("copies")), "print-rows")
    grouped = stored(rows.join(groups.hint("merge"), "fp").select("group", "doc_id", "key", "copies"), "grouped")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    first = stored(grouped.groupBy("group").agg(least.alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key")), "first")
    stays = (F.col("key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    repeated = stored(grouped.where("copies > 1").join(first, stays, "left_semi").select("doc_id", "key"), "repeated")
    gone = stored(grouped.join(first, stays, "left_anti").select("doc_id", "key"), "gone")
    return without(docs, gone, repeated)
