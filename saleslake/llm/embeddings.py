"""Near-duplicate embeddings by product quantisation.

Unit vectors are put into coarse inverted lists. A vector goes into each list whose cell is within half of the
search radius, so two vectors within the radius always share a list (that of the point between them). In a list, residual
subspace codes give asymmetric table-lookup distances; with each code's own error these bound the true distance from
below, so what they reject is no link, and the rest is ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import stored
from saleslake.llm.components import connected
from saleslake.llm.simhash import lowest_linked

# The codebook is fitted on at most this many vectors; every vector is indexed.
SAMPLE = 20_000
MOST_LISTS = 4096
SUBSPACES = 8
CODEWORDS = 256
# Vectors of one list that a task compares with as many others.
CHUNK = 2048
_QUERIES_AT_ONCE = 256
_SLACK = 1e-4


def _means(points: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """At most k cluster means; the start is spread over the (hash-ordered) points, so runs agree."""
    means = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(turns):
        near = _nearest(points, means)
        sums, n = np.zeros_like(means), np.bincount(near, minlength=len(means))
        np.add.at(sums, near, points)
        means[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return means


def _nearest(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    half = (means**2).sum(1) / 2
    return np.concatenate([np.argmax(points[i : i + 2048] @ means.T - half, 1) for i in range(0, len(points), 2048)])


class Codebook:
    """Coarse centroids and residual codewords for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = _means(sample, lists)
        residuals = sample - self.centroids[_nearest(sample, self.centroids)]
        edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.words = [_means(np.ascontiguousarray(residuals[:, part]), CODEWORDS, 5) for part in self.parts]

    def lists(self, units: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each vector all lists whose cell is at most `reach` away, judged by the border between two cells."""
        c = self.centroids
        between = np.sqrt(np.maximum((c**2).sum(1)[:, None] - 2 * c @ c.T + (c**2).sum(1), 1e-12))
        found = []
        for start in range(0, len(units), 1024):
            far = (c**2).sum(1) - 2 * units[start : start + 1024] @ c.T
            own = far.argmin(1)
            margin = (far - far[np.arange(len(own)), own][:, None]) / (2 * between[own])
            near = margin <= reach + _SLACK
            near[np.arange(len(own)), own] = True
            found += [np.flatnonzero(row) for row in near]
        return found

    def codes(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the error each code makes."""
        codes = np.stack([_nearest(residuals[:, part], words) for part, words in zip(self.parts, self.words, strict=True)], 1)
        rebuilt = np.concatenate([words[codes[:, m]] for m, words in enumerate(self.words)], 1)
        return codes.astype(np.uint8), np.sqrt(((residuals - rebuilt) ** 2).sum(1))

    def distances(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of query residuals to coded ones, from one table per query and subspace."""
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, (part, words) in enumerate(zip(self.parts, self.words, strict=True)):
            q = queries[:, part]
            table = (q**2).sum(1)[:, None] - 2 * q @ words.T + (words**2).sum(1)
            total += table[:, codes[:, m]]
        return total


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def _shared_before(lists: list[list[int]], own: int) -> np.ndarray:
    """For each vector a bit set of its lists before this one; a pair is judged in the first list it shares."""
    found = np.zeros((len(lists), own // 8 + 1), np.uint8)
    for i, row in enumerate(lists):
        for x in row:
            if x < own:
                found[i, x >> 3] |= 1 << (x & 7)
    return found


def list_links(book: Codebook | None, own: int, vectors: np.ndarray, codes: np.ndarray, errors: np.ndarray, lists: list[list[int]], side: np.ndarray, within: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions i < j) in one list with at least the cosine.

    `side` tells the two chunks apart that are compared; `within` compares a chunk with itself.
    """
    norms = np.sqrt((vectors**2).sum(1))
    units = vectors / norms[:, None]
    before = _shared_before(lists, own)
    radius = np.sqrt(max(0.0, 2 - 2 * cosine))
    residuals = (units - book.centroids[own]).astype(np.float32) if book else None
    n = len(vectors)
    left = np.arange(n) if within else np.flatnonzero(side == 0)
    right = np.arange(n) if within else np.flatnonzero(side == 1)
    for start in range(0, len(left), _QUERIES_AT_ONCE):
        block = left[start : start + _QUERIES_AT_ONCE]
        if book:
            near = np.sqrt(np.maximum(book.distances(residuals[block], codes[right]), 0)) <= radius + errors[right] + 10 * _SLACK
        else:
            near = np.ones((len(block), len(right)), bool)
        i, j = np.nonzero(near)
        i, j = block[i], right[j]
        if within:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 65_536):
            a, b = i[at : at + 65_536], j[at : at + 65_536]
            close = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) >= cosine
            a, b = a[close], b[close]
            first = ~(before[a] & before[b]).any(1)
            yield a[first], b[first]


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least `cosine`.
    Vectors that are null, empty, zero or hold null or non-finite components, that have no label, or lengths that differ,
    link to nothing: they have no links, are their own component and are kept. Identical vectors of one label are searched for
    once and counted as often as they occur, repeated rows included. A null vec_id is no identifier: its row is
    linked if another row has the same vector, else it has a null component, and it is never kept. An empty table
    gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    whole = F.col("embedding").cast("array<double>")
    rows = stored(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("embedding")).withColumn(
            "usable", F.col("label").isNotNull() & _usable(F.col("embedding"))
        ),
        "vectors",
    )
    classes = stored(
        rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")),
        "vector-classes",
    )
    searched = classes.where("first is not null")

    # A bounded sample, the same at each run: the vectors with the smallest hashes.
    drawn = [row[0] for row in searched.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).collect()]
    total = searched.count()
    books: dict[int, Codebook] = {}
    for length in sorted({len(x) for x in drawn}):
        points = np.array([x for x in drawn if len(x) == length])
        points = (points / np.sqrt((points**2).sum(1))[:, None]).astype(np.float32)
        books[length] = Codebook(points, min(MOST_LISTS, max(1, len(points) // 8), max(16, 4 * round(total**0.5))))
    shared = spark.sparkContext.broadcast(books)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) / 2

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                out = []
                arrays = [np.array(x) for x in part.column(2).to_pylist()]
                lengths = np.array([len(x) for x in arrays])
                ids, copies, labels = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()
                for length in np.unique(lengths):
                    members = np.flatnonzero(lengths == length)
                    full = np.stack([arrays[i] for i in members])
                    book = shared.value.get(int(length))
                    if book is None:  # a length that is not in the sample: one list, without codes
                        out += [(labels[i], int(length), 0, ids[i], copies[i], full[k].tobytes(), b"", 0.0, [0]) for k, i in enumerate(members)]
                        continue
                    units = (full / np.sqrt((full**2).sum(1))[:, None]).astype(np.float32)
                    lists = book.lists(units, reach)
                    who = np.repeat(np.arange(len(members)), [len(x) for x in lists])
                    where = np.concatenate(lists)
                    codes, errors = book.codes(units[who] - book.centroids[where])
                    for k, at, code, error in zip(who, where, codes, errors, strict=True):
                        i = members[k]
                        out.append((labels[i], int(length), int(at), ids[i], copies[i], full[k].tobytes(), code.tobytes(), float(error), lists[k].tolist()))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["label", "length", "list", "id", "copies", "vector", "codes", "error", "lists"]
    kinds = [
        pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float32(), pa.list_(pa.int32()),
    ]
    indexed = stored(
        searched.select("first", "copies", "embedding", F.col("label").cast("string").alias("label")).mapInArrow(
            index, "label string, length int, list int, id long, copies long, vector binary, codes binary, error float, lists array<int>"
        ),
        "index",
    )
    # Long lists are cut into chunks, and each chunk meets each other one in a task of its own.
    sizes = indexed.groupBy("label", "length", "list").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    placed = indexed.join(stored(sizes, "list-sizes").hint("merge"), ["label", "length", "list"]).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    )
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *names, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )

    def compare(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        length, own, a, b = (x.as_py() for x in key[1:])
        found = found.sort_by("id")
        ids, copies = found.column("id").to_numpy(), found.column("copies").to_numpy()
        book = shared.value.get(length)
        codes = np.stack([np.frombuffer(x, np.uint8) for x in found.column("codes").to_pylist()])
        links = np.zeros(len(ids), np.int64)
        left, right = [], []
        for i, j in list_links(
            book, own, _vectors(found.column("vector")), codes, found.column("error").to_numpy(),
            found.column("lists").to_pylist(), found.column("side").to_numpy(), a == b, cosine,
        ):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            left.append(i)
            right.append(j)
        label = lowest_linked(np.concatenate(left), np.concatenate(right), len(ids)) if left else np.arange(len(ids))
        some = links > 0
        return pa.table({"id": ids[some], "low": ids[label[some]], "links": links[some]})

    met_links = stored(
        met.groupBy("label", "length", "list", "a", "b").applyInArrow(compare, "id long, low long, links long"),
        "vector-links",
    )
    parts = connected(met_links.select(F.col("id").alias("u"), F.col("low").alias("v")))
    counted = met_links.groupBy("id").agg(F.sum("links").alias("links"))
    named = stored(
        classes.join(counted, F.col("first") == F.col("id"), "left")
        .join(parts, F.col("first") == F.col("node"), "left")
        .select(
            F.col("label").alias("of_label"),
            F.col("embedding").alias("of_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "first").alias("component"),
        ),
        "named-vectors",
    )
    same = F.col("usable") & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_embedding"))
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return rows.join(named.hint("merge"), same, "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
