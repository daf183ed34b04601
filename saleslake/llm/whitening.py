"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Entries become integers, so n^2 times their covariance is a matrix of integers, known exactly. Its characteristic polynomial is
computed modulo many primes (a Hessenberg form, then a recurrence), each in a task, and put together by the Chinese remainder
theorem. All its roots are real and none is negative, so sign changes count them exactly: roots are isolated by
bisection and refined far below their distances. A component is the null space of the matrix less its root, found by inverse
iteration in fixed-point numbers of a few hundred bits, each in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake.llm.common import pieces_of, stored

SCALE = 64
COMPONENTS = 32
# Products of two residues fit 64 bits.
_PRIME_BITS = 31
# Roots are known to this many bits below the smallest one that is not zero, and numbers of the iteration to as many more.
_ROOT_BITS = 128
_GUARD_BITS = 64
_ROWS_AT_ONCE = 2048


def usable(embedding: Column) -> Column:
    """Whether a vector has entries, and all of them are finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(embedding) > 0), F.lit(False))


def integer_vectors(vectors: DataFrame, scale: int = SCALE, offset: int = 0) -> DataFrame:
    """(vec_id, x): the usable vectors with entries floor(scale * c) + offset, of the length that most have (of two such, the longer).

    Entries of 2^62 or more end the job: their squares could not be counted exactly in what Spark has.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def integer(c: Column) -> Column:
        scaled = F.floor(F.lit(float(scale)) * c)
        return F.when(F.abs(c) * scale < float(1 << 62), scaled + F.lit(offset)).otherwise(F.raise_error(F.lit("a vector's entry is too large")).cast("long"))

    found = stored(whole.where(usable(F.col("embedding"))).select("vec_id", F.transform("embedding", integer).alias("x")), "integer-vectors")
    lengths = found.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return found.where(F.size("x") == (lengths["length"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _product(x: np.ndarray) -> np.ndarray:
    """The exact sums of products of the columns, as integers of any size."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:  # exact in doubles
        whole = x.astype(np.float64)
        return (whole.T @ whole).astype(np.int64).astype(object)
    whole = x.astype(object)
    return whole.T @ whole


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, m) of integer vectors x: m is n^2 times their covariance, exactly.

    Tasks add up products; what is left are d * (d + 1) / 2 sums for d dimensions, which are gathered.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, None, None
        for batch in pieces_of(batches, _ROWS_AT_ONCE):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            n += len(x)
            part, of_columns = _product(x), x.astype(object).sum(0)
            products = part if products is None else products + part
            sums = of_columns if sums is None else sums + of_columns
        if n:
            i, j = np.triu_indices(len(sums))
            rows = np.append(np.full(len(sums) + 1, -1), i)
            columns = np.concatenate([[-1], np.arange(len(sums)), j])
            values = [n, *sums, *products[i, j]]
            yield pa.record_batch(
                [pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))],
                names=["i", "j", "value"],
            )

    parts = vectors.select("x").mapInArrow(add_up, "i int, j int, value decimal(38,0)")
    found = {(r["i"], r["j"]): int(r["value"]) for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    if not found:
        return 0, [], []
    n = found[-1, -1]
    d = max(j for _, j in found) + 1
    sums = [found[-1, j] for j in range(d)]
    return n, sums, [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 3 * 10^9."""
    if n % 2 == 0:
        return n == 2
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (n - 1) >> twos, n)
        if x in (1, n - 1) or n == base:
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The greatest primes of `_PRIME_BITS` bits whose product exceeds `bound`."""
    found, product, n = [], 1, (1 << _PRIME_BITS) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(z - matrix) modulo p, the constant first: Hessenberg form, then its leading minors' recurrence."""
    d = len(matrix)
    a = np.array([[v % p for v in row] for row in matrix], np.int64).reshape(d, d)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factors = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factors[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factors % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        minors[k + 1, 1:] = minors[k, :-1]
        weights = np.zeros(k + 1, np.int64)
        below = 1
        for i in range(k, -1, -1):
            weights[i] = int(a[i, k]) * below % p
            below = below * int(a[i, i - 1]) % p if i else 0
        minors[k + 1] = (minors[k + 1] - (weights[:, None] * minors[: k + 1] % p).sum(0)) % p
    return minors[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients e_0 = 1, e_1, ..., e_d: det(z - matrix) is the sum of (-1)^k e_k z^(d-k). The matrix has no negative root.

    e_k is then at most C(d, k) * (trace / d)^k, so enough primes give it exactly.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1))
    primes = primes_beyond(bound)
    shared = spark.sparkContext.broadcast(matrix)  # d^2 numbers

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = polynomial_modulo(shared.value, p)
                yield pa.record_batch([pa.array([p]), pa.array([found], pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    residues = {r["p"]: r["residues"] for r in dealt.mapInArrow(reduce, "p long, residues array<long>").collect()}
    product, values = 1, [0] * (d + 1)
    for p in primes:
        inverse = pow(product, -1, p)
        signed = [residues[p][d - k] * (-1) ** k for k in range(d + 1)]
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, signed, strict=True)]
        product *= p
    return values


def _roots_beyond(poly: list[int], at: int) -> int:
    """How many roots (all are real; `poly` has the constant first) are greater than `at`: sign changes after a shift."""
    shifted = list(poly)
    for stop in range(len(shifted) - 1):
        carry = shifted[-1]
        for i in range(len(shifted) - 2, stop - 1, -1):
            carry = shifted[i] = shifted[i] + at * carry
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def roots(e: list[int], most: int) -> list[tuple[Fraction, int]]:
    """The `most` greatest roots that are not zero, greatest first, and how many lie so close together that nothing tells them apart.

    `e` are the coefficients of `characteristic_polynomial`. A root's error is at most 2^-128 of the smallest one.
    """
    while len(e) > 1 and not e[-1]:
        e = e[:-1]
    d = len(e) - 1
    if not d:
        return []
    # The smallest root is at least e_d / e_(d-1), the greatest at most e_1.
    bits = max(0, _ROOT_BITS - (e[d] // e[d - 1]).bit_length() + 1) if e[d] >= e[d - 1] else _ROOT_BITS + (e[d - 1] // e[d]).bit_length()
    poly = [(-1) ** k * e[k] << (k * bits) for k in range(d, -1, -1)]  # of z * 2^bits

    def sign_at(z: int) -> int:
        value = 0
        for c in reversed(poly):
            value = value * z + c
        return (value > 0) - (value < 0)

    # (low, high, roots beyond low, roots beyond high): the roots in (low, high].
    todo, found = [(0, (e[1] << bits) + 1, d, 0)], []
    while todo:
        low, high, beyond_low, beyond_high = todo.pop()
        if beyond_high >= most:
            continue
        n = beyond_low - beyond_high
        if not n:
            continue
        if n == 1:
            # A simple root: the sign to the left of it is that of (-1)^(roots beyond low).
            left = -1 if beyond_low % 2 else 1
            while high - low > 1:
                middle = (low + high) // 2
                if sign_at(middle) == left:
                    low = middle
                else:
                    high = middle
        if high - low == 1:
            found.append((high, n))
            continue
        middle = (low + high) // 2
        beyond = _roots_beyond(poly, middle)
        todo += [(low, middle, beyond_low, beyond), (middle, high, beyond, beyond_high)]
    return [(Fraction(z, 1 << bits), n) for z, n in sorted(found, reverse=True)]


def null_vectors(matrix: list[list[int]], root: Fraction, many: int) -> list[list[float]]:
    """`many` orthonormal vectors that the matrix less `root` takes to nothing, each with its greatest entry positive."""
    d = len(matrix)
    bits = root.denominator.bit_length() + _ROOT_BITS + _GUARD_BITS
    one = 1 << bits
    shift = (root.numerator << bits) // root.denominator
    a = np.array([[int(v) << bits for v in row] for row in matrix], object)
    a[range(d), range(d)] -= shift
    # Elimination with the row of the greatest entry first; the steps are kept for the other right-hand sides.
    steps = []
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, pivot]] = a[[pivot, k]]
        a[k, k] = a[k, k] or 1
        factors = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k:] -= (factors[:, None] * a[k, k:]) >> bits
        steps.append((pivot, factors))

    def solved(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for k, (pivot, factors) in enumerate(steps):
            b[k], b[pivot] = b[pivot], b[k]
            b[k + 1 :] -= (factors * b[k]) >> bits
        for k in range(d - 1, -1, -1):
            b[k] = ((b[k] - (int((a[k, k + 1 :] * b[k + 1 :]).sum()) >> bits)) << bits) // a[k, k]
        return b

    def unit(b: np.ndarray) -> np.ndarray:
        return (b << bits) // max(1, math.isqrt(int((b * b).sum())))

    found: list[np.ndarray] = []
    draw = np.random.default_rng(d)
    for _ in range(many):
        b = unit(np.array([int(v) for v in draw.integers(1, 1 << 32, d)], object))
        for _ in range(3):
            b = solved(b)
            # Twice, as the first time leaves what was lost when nearly all is taken away.
            for _ in range(2):
                b = unit(b)
                for other in found:
                    b = b - ((other * (int((b * other).sum()) >> bits)) >> bits)
            b = unit(b)
        found.append(b if b[int(np.argmax(np.abs(b)))] > 0 else -b)
    return [[int(v) / one for v in b] for b in found]


def components(spark: SparkSession, matrix: list[list[int]], most: int = COMPONENTS) -> list[tuple[Fraction, list[float]]]:
    """(root, unit vector) of the `most` greatest roots of a matrix of integers without negative roots; roots of zero are left out."""
    wanted = roots(characteristic_polynomial(spark, matrix), most)
    if not wanted:
        return []
    shared = spark.sparkContext.broadcast((matrix, wanted))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows, (root, n) = shared.value[0], shared.value[1][k]
                found = null_vectors(rows, root, n)
                yield pa.record_batch([pa.array([k] * n, pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["k", "vector"])

    tasks = min(len(wanted), spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(k,) for k in range(len(wanted))], "k int").repartition(tasks)
    vectors: dict[int, list[list[float]]] = {}
    for row in dealt.mapInArrow(solve, "k int, vector array<double>").collect():
        vectors.setdefault(row["k"], []).append(list(row["vector"]))
    return [(root, v) for k, (root, _) in enumerate(wanted) for v in sorted(vectors[k])][:most]


class Whitening:
    """The fit over integer vectors: count, sums, components, and shares of the variance."""

    def __init__(self, spark: SparkSession, vectors: DataFrame, most: int = COMPONENTS):
        self.n, self.sums, matrix = scatter(vectors)
        found = components(spark, matrix, most) if self.n else []
        trace = sum(matrix[i][i] for i in range(len(matrix)))
        self.explained = [float(root / trace) for root, _ in found]
        # The matrix is n^2 times the covariance, and n * x - sums n times a centred x: the factors cancel.
        self.rows = np.array([v for _, v in found], np.float64).reshape(len(found), len(self.sums))
        self.roots = np.array([math.sqrt(root) for root, _ in found])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as 64-bit integers where they fit."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) @ self.rows.T) / self.roots


def _deviations(centred: np.ndarray) -> list[Decimal]:
    most = int(np.abs(centred).max(initial=0))
    if most * most * centred.shape[1] >= 1 << 63:
        centred = centred.astype(object)
    return [Decimal(int(v)) for v in (centred * centred).sum(1)]


def identity_error(vectors: DataFrame, fit: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity; two passes, as it is centred first."""
    k = len(fit.roots)
    if not k:
        return None
    shared = vectors.sparkSession.sparkContext.broadcast(fit)

    def totals(mean: np.ndarray | None) -> np.ndarray:
        """Sums of the whitened vectors, or sums of products of what is left of them without the mean."""

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in pieces_of(batches, _ROWS_AT_ONCE):
                if batch.num_rows:
                    w = shared.value.whitened(shared.value.centred(_matrix(batch.column(0))))
                    total = total + (w.sum(0) if mean is None else ((w - mean).T @ (w - mean)).ravel())
            if np.ndim(total):
                yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "value"])

        parts = vectors.select("x").mapInArrow(add_up, "at int, value double")
        found = parts.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
        return np.array([r["value"] for r in found])

    mean = totals(None) / fit.n
    return float(np.abs(totals(mean).reshape(k, k) / fit.n - np.eye(k)).max())


def whitened(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, offset: int = 0) -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries are left out, as are those whose length is not the one that most
    have (of two such lengths the longer counts). Entries become x = floor(scale * c) + offset. n counts the vectors, each row as
    often as it occurs; `deviation` (decimal) is the sum over dimensions of (n * x - sum of x)^2, `whitened` the centred x
    projected on the component, over the root of its variance, `explained` the component's share of all variance,
    `identity_error` the largest absolute entry of the covariance of `whitened` less the identity. Components are numbered from 1 by falling variance, at most `most`; those without any
    variance are left out, so vectors that are all equal give no rows, as an empty table does. A null vec_id stays
    null; further columns are ignored. A component's greatest entry is positive; within equal variances any basis will do.
    The driver and tasks hold d^2 numbers for d dimensions, however many vectors there are.
    """
    spark = vectors.sparkSession
    found = integer_vectors(vectors, scale, offset)
    fit = Whitening(spark, found, most)
    error = identity_error(found, fit)
    shared = spark.sparkContext.broadcast(fit)
    shape = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    names = [part.split()[0] for part in shape.replace("(38,0)", "").split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        k = len(fitted.roots)
        for batch in pieces_of(batches, _ROWS_AT_ONCE):
            if not (batch.num_rows and k):
                continue
            centred = fitted.centred(_matrix(batch.column(1)))
            each = np.repeat(np.arange(batch.num_rows), k)
            deviation = pa.array(_deviations(centred), pa.decimal128(38, 0))
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(each), fitted.n)),
                deviation.take(pa.array(each)),
                pa.array(fitted.whitened(centred).ravel()),
                pa.array(np.tile(fitted.explained, batch.num_rows)),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.record_batch(columns, names=names)

    return found.select("vec_id", "x").mapInArrow(project, shape)


def whitened_rows(vectors: DataFrame) -> DataFrame:
    """`whitened` in the form of the query; a deviation that a long cannot hold is null."""
    return whitened(vectors, offset=1_000_000).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
