"""Periodic runs of words by a descending-LCP Kruskal over suffix classes.

The suffixes of a document's words are sorted by prefix doubling. Neighbours in that order are united from the longest
common prefix (LCP) down, as Kruskal's algorithm does with edges; each class keeps its positions in order. Two positions
that become neighbours in a class at LCP l, at a distance d of at most l, begin a stretch of l + d words with period d.
No smaller period fits, as a position between them would have joined earlier; and each run is met once
at its own first word. Documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import pieces_of, text_bytes

# Words of short documents that are sorted together; a longer document is sorted alone.
_WORDS_AT_ONCE = 1 << 17

Run = tuple[int, int, int]  # start, length, period


def _levels(keys: np.ndarray, ends: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Ranks of all positions by their first 1, 2, 4, ... words, until all differ; the last ranks are the suffixes' order.

    Equal ranks mean equal words within one document. `keys` tells words of one document, and documents, apart; `ends` is where
    a position's document ends. Each array has one rank more, -1, for the end of all.
    """
    n = len(keys)
    rank = np.full(n + 1, -1, np.int64)
    at = np.arange(n)
    group = np.zeros(n, np.int64)  # the rank that a position shares with others so far
    found, width = [], 0
    while True:
        order = np.argsort(group * (n + 2) + keys + 1)
        at, group, keys = at[order], group[order], keys[order]
        new_group = np.append(True, group[1:] != group[:-1])
        new = new_group | np.append(True, keys[1:] != keys[:-1])
        place = np.arange(len(at))
        inside = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
        rank[at] = group + inside
        width = 2 * width or 1
        found.append((width, rank.astype(np.int32 if n < 1 << 31 else np.int64)))
        shared = ~new | ~np.append(new[1:], True)
        at = at[shared]
        if not len(at):
            return found
        group = rank[at]
        following = at + width
        keys = np.where(following < ends[at], rank[np.minimum(following, n)], -1)


def _common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b (a <> b)."""
    lcp = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        last = len(rank) - 1
        lcp += width * (rank[np.minimum(a + lcp, last)] == rank[np.minimum(b + lcp, last)])
    return lcp


def _united(places: list[int], edges: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(i, j, lcp) of positions that become neighbours when the classes of `edges` (lcp, k), the longest first, are united.

    An edge joins the classes of the k-th and the next of `places`, the positions in the suffixes' order.
    """
    parent = list(range(len(places)))
    members: list[list[int] | None] = [[x] for x in places]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for lcp, k in edges:
        a, b = root(k), root(k + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        parent[b], members[b] = a, None
        for x in small:
            insort(large, x)
        for nth, x in enumerate(small):
            at = bisect_left(large, x)
            # Neighbours from the same class are not new.
            if at and not (nth and large[at - 1] == small[nth - 1]):
                yield large[at - 1], x, lcp
            if at + 1 < len(large) and not (nth + 1 < len(small) and large[at + 1] == small[nth + 1]):
                yield x, large[at + 1], lcp


def runs_of(documents: list[list[bytes]], length: int = 6, exponent: int = 4) -> list[list[Run]]:
    """For each document's words all runs with at least `length` words and `exponent` periods, by start, then period."""
    if length < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    found: list[list[Run]] = [[] for _ in documents]
    sizes = np.array([len(x) for x in documents], np.int64)
    if not sizes.sum():
        return found
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for words in documents for w in words), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(documents)), sizes)
    levels = _levels(doc * len(names) + ids, np.repeat(starts + sizes, sizes))

    # Only suffixes that share as much as the shortest run needs can be linked.
    least = min(max(length - q, (exponent - 1) * q) for q in range(1, length + 1))
    order = np.empty(len(ids), np.int64)
    order[levels[-1][1][:-1]] = np.arange(len(ids))
    near = [rank for width, rank in levels if width <= least][-1]
    shared = np.append(False, near[order[1:]] == near[order[:-1]])
    shared |= np.append(shared[1:], False)
    places = order[shared]
    if not len(places):
        return found
    lcp = _common(levels, places[:-1], places[1:])
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    for i, j, common in _united(places.tolist(), list(zip(lcp[edges].tolist(), edges.tolist(), strict=True))):
        period = j - i
        if common < (exponent - 1) * period or common + period < length:
            continue
        start = int(starts[doc[i]])
        if i == start or ids[i - 1] != ids[j - 1]:  # nothing before it belongs to the run
            found[doc[i]].append((i - start, common + period, period))
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equal ones the first, then that with the smallest period."""
    return min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run repeats, joined by a blank."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(w for w, stays in zip(words, keep.tolist(), strict=True) if stays)


def periodic_runs(
    docs: DataFrame, length: int = 6, exponent: int = 4, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period), strongest, text.

    A run is a stretch of consecutive words with smallest period q, at least `length` words and `exponent` periods, that no neighbouring
    word extends. Runs are ordered by start, then period; `strongest` is the one with the greatest length / period (ties:
    smallest start, then period; null without runs). `text` has the words without those after the first period of any run, joined by
    a blank. Words are what white space separates; `rewrite` may change a document's words (given its id) first.

    A null or empty text has no words, no runs and an empty text. Each row is a document, whatever its id; ids may be null or
    repeated. An empty table gives no rows; further columns are ignored. A document is handled in one task, in memory and
    time in proportion to its words (times their logarithm).
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "runs": pa.list_(run), "strongest": run, "text": pa.binary()}

    def handled(ids: list[int | None], documents: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(documents, length, exponent)
        columns = [
            ids,
            [len(words) for words in documents],
            found,
            [strongest(runs) for runs in found],
            [collapsed(words, runs) for words, runs in zip(documents, found, strict=True)],
        ]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            ids, documents, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().split()
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                if documents and size + len(words) > _WORDS_AT_ONCE:
                    yield handled(ids, documents)
                    ids, documents, size = [], [], 0
                ids.append(doc_id)
                documents.append(words)
                size += len(words)
            if documents:
                yield handled(ids, documents)

    of = "struct<start:long,length:long,period:long>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    found = source.mapInArrow(detect, f"doc_id long, n_words long, runs array<{of}>, strongest {of}, text binary")
    return found.withColumn("text", F.col("text").cast("string"))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query looks at: those of every tenth document, by the crc32 of its id, repeat from some word on.

    With h that crc32 and g = h / 10, each word i >= a is word a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8).
    A null id counts as the empty text, whose crc32 is zero.
    """
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    rest = len(words) - a
    part = words[a : a + 1 + rest // (3 + g % 8)]
    return words[:a] + (part * (rest // len(part) + 1))[:rest]


def run_digests(docs: DataFrame) -> DataFrame:
    """`periodic_runs` of the `looped` words in the form of the query."""
    found = periodic_runs(docs, rewrite=looped)
    best = F.col("strongest")
    listed = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", listed).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
