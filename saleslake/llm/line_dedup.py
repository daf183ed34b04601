"""Line dedup: hashes of lines in ranges, sorted by document and position; the first occurrences stream by.

Lines are sent as (hash, document, position), range-partitioned by all three, so a line that a third of all documents have
is cut into as many partitions as its rows fill. Each partition is sorted and read once: the first document of a hash is the
first row's. Only the group at the start of a partition may have begun in an earlier one; two rows a partition
(its first and its last group) tell which. What comes out are bitmaps of the lines that stay; texts are not sent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import WHITE_SPACE, pieces_of, row_key, stored, text_bytes
from saleslake.operators.joins import lookup_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ORDER = ["hi", "lo", "no_id", "doc", "key", "position"]
_FOUND = "no_id boolean, doc long, key long, position int, hi long, lo long, edge boolean"


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """(hi, lo, no_id, doc, key, position): a row for each line whose key has at least `least` code points.

    The two hashes are of the line without white space at its ends and with A-Z lower-cased; `key` is the `row_key`.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    doc_id = F.col("doc_id").cast("long")
    split = docs.select(
        doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("doc"), row_key().alias("key"), F.posexplode(lines).alias("position", "line")
    )
    bare = split.withColumn("line", F.translate(F.btrim("line", F.lit(WHITE_SPACE)), _UPPER, _LOWER))
    return bare.where(F.char_length("line") >= least).select(F.xxhash64("line").alias("hi"), F.xxhash64(F.lit(1), "line").alias("lo"), *_ORDER[2:])


def _steps(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first one does."""
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for column in columns:
        changed[1:] |= column[1:] != column[:-1]
    return changed


def _found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a sorted partition that are not in their hash's first document, and all lines of its first group.

    Rows of the first group carry their hash. At the end come two rows with `edge`: the first document here of the
    first and of the last group.
    """
    names = [part.split()[0] for part in _FOUND.split(", ")]
    first_group = last = None  # (hi, lo, no_id, doc) of the partition's first group, and of the one being read
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, no_id, doc, key, position = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        starts = np.flatnonzero(_steps(hi, lo))
        group = np.cumsum(_steps(hi, lo)) - 1
        first_no_id, first_doc = no_id[starts], doc[starts]
        if last is not None and (hi[0], lo[0]) == last[:2]:
            first_no_id[0], first_doc[0] = last[2:]
        if first_group is None:
            first_group = (hi[0], lo[0], first_no_id[0], first_doc[0])
        last = (hi[starts[-1]], lo[starts[-1]], first_no_id[-1], first_doc[-1])
        open_ = (hi == first_group[0]) & (lo == first_group[1])
        out = open_ | (no_id != first_no_id[group]) | (doc != first_doc[group])
        hashes = [pa.array(x[out], mask=~open_[out]) for x in (hi, lo)]
        found = [pa.array(x[out]) for x in (no_id, doc, key, position)]
        yield pa.record_batch([*found, *hashes, pa.array(np.zeros(int(out.sum()), bool))], names=names)
    if first_group is not None:
        hi, lo, no_id, doc = zip(first_group, last, strict=True)
        none = pa.nulls(2, pa.int64())
        columns = [
            pa.array(no_id, pa.bool_()), pa.array(doc, pa.int64()), none, pa.nulls(2, pa.int32()),
            pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array([True, True]),
        ]
        yield pa.record_batch(columns, names=names)


def repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, key, position) of each line that an earlier document has too, by smallest doc_id."""
    lines = stored(line_hashes(docs, least), "lines")
    placed = lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    found = stored(placed.mapInArrow(_found_in, _FOUND), "found-lines")
    # Two rows a partition.
    edges = found.where("edge").groupBy(F.col("hi").alias("of_hi"), F.col("lo").alias("of_lo"))
    first = edges.agg(F.min(F.struct("no_id", "doc")).alias("first"))
    same = (F.col("hi") == F.col("of_hi")) & (F.col("lo") == F.col("of_lo"))
    later = F.col("first").isNull() | (F.col("first.no_id") != F.col("no_id")) | (F.col("first.doc") != F.col("doc"))
    dropped = found.where("not edge").join(F.broadcast(first), same, "left").where(later)
    return dropped.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "key", "position")


def packed(dropped: list[int]) -> bytes:
    """A compressed bitmap of the lines that stay, up to the byte of the last one that goes."""
    keep = np.ones(max(dropped) // 8 * 8 + 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpacked(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of the lines stay; lines beyond the bitmap do, and all without one."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, key, keep) of the documents that lose lines: `keep` is a `packed` bitmap, `key` the `row_key`.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least `least` code points that
    at least two documents hold stay in the one with the smallest doc_id only, there as often as they occur.
    Rows that share a doc_id are one document; those without a doc_id are one too, after all others. A null text is one empty line.
    An empty table gives no rows; further columns are ignored, whatever their names. A document is one row; its bitmap is made
    in one task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([packed(x) for x in batch.column(2).to_pylist()], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), keep], names=["doc_id", "key", "keep"])

    # Rows that repeat id and text are one key; what they repeat is left out before positions are gathered.
    positions = repeated_lines(docs, least).distinct().groupBy("doc_id", "key").agg(F.collect_list("position").alias("dropped"))
    return positions.mapInArrow(pack, "doc_id long, key long, keep binary")


def without_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (the lines that stay, joined by a line feed).

    What stays is told by `keep_bitmaps`. Repeated rows each get a row; a null text is one empty line; an empty table gives no rows.
    """
    bitmaps = stored(keep_bitmaps(docs, least).withColumnRenamed("doc_id", "of_id"), "bitmaps")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text_bytes().alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id"))
    marked = lookup_join(texts, bitmaps, "key", "left", ["key"], residual=same)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            counts, gone, kept = [], [], []
            for text, bitmap in zip(batch.column(1), batch.column(2), strict=True):
                lines = text.as_py().split(b"\n")
                keep = unpacked(bitmap.as_py(), len(lines))
                counts.append(len(lines))
                gone.append(len(lines) - int(keep.sum()))
                kept.append(b"\n".join(line for line, stays in zip(lines, keep, strict=True) if stays))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n_lines", "n_dropped", "text"])

    applied = marked.select("doc_id", "text", "keep").mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, text binary")
    return applied.withColumn("text", F.col("text").cast("string"))


def line_digests(docs: DataFrame, least: int = 10) -> DataFrame:
    """`without_repeated_lines` in the form of the query: doc_id, n_lines, n_dropped, kept_sha256."""
    return without_repeated_lines(docs, least).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
