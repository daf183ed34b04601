import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import HERE, SF, empty_documents, odd_documents
from pyspark.sql import functions as F

from saleslake.llm import ppm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Plain:
    """PPM by dictionaries, one byte after the other."""

    def __init__(self, texts, order):
        self.order, self.seen, self.tally = order, defaultdict(Counter), {}
        for line in map(self.line, texts):
            for i in range(order, len(line)):
                for length in range(order + 1):
                    self.seen[line[i - length : i]][line[i]] += 1

    def line(self, text):
        return b"\xfe" * self.order + b" ".join((text or "").translate(LOWER).encode().split()) + b"\xff"

    def rate(self, length, total, symbols):
        """Escapes among the occurrences of this class, each left out of its context in turn."""
        if length not in self.tally:
            tally = defaultdict(lambda: [0.5, 1.0])
            for context, counts in self.seen.items():
                n, d = sum(counts.values()), len(counts)
                if len(context) == length and n > 1:
                    for times in counts.values():
                        new = times == 1
                        entry = tally[self.state(n - 1, d - new)]
                        entry[0] += times * new
                        entry[1] += times
            self.tally[length] = tally
        escapes, all_ = self.tally[length][self.state(total, symbols)]
        return escapes / all_

    @staticmethod
    def state(n, d):
        return min(n if n < 8 else 4 + int(2 * math.log2(n)), 39), min(d if d < 8 else 5 + int(math.log2(d)), 15)

    def probability(self, context, symbol):
        left, excluded = 1.0, set()
        for length in range(self.order, -1, -1):
            counts = {s: n for s, n in self.seen[context[len(context) - length :]].items() if s not in excluded}
            total = sum(counts.values())
            if not total:
                continue
            escape = self.rate(length, total, len(counts))
            if symbol in counts:
                return left * (1 - escape) * counts[symbol] / total
            left *= escape
            excluded |= set(counts)
        return left / (256 - len(excluded))

    def score(self, text):
        line = self.line(text)
        return sum(math.log10(self.probability(line[i - self.order : i], line[i])) for i in range(self.order, len(line)))


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def base(rows):
    counts = Counter()
    tokens = {i: [*(text or "").translate(LOWER).encode().split(), None] for i, (_, text) in enumerate(rows)}
    for i, (doc_id, _) in enumerate(rows):
        if not held_out(doc_id):
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    return n, [(len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for t in tokens.values()]


def check(docs, order):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = Plain([text for doc_id, text in rows if not held_out(doc_id)], order)
    total, bases = base(rows)
    want = sorted(((doc_id, held_out(doc_id), b[0], b[1], total, round(b[2], 6), model.score(text)) for (doc_id, text), b in zip(rows, bases, strict=True)), key=repr)
    found = sorted((tuple(r) for r in ppm.scored(docs, order).collect()), key=repr)
    assert len(found) == len(want)
    for got, expected in zip(sorted(found, key=lambda r: (repr(r[0]), r[2], r[6])), sorted(want, key=lambda r: (repr(r[0]), r[2], r[6])), strict=True):
        assert got[:5] == expected[:5]
        assert got[5] == pytest.approx(expected[5], abs=1e-5)
        assert got[6] == pytest.approx(expected[6], rel=1e-5, abs=1e-4)


def test_odd_documents(spark):
    check(odd_documents(spark).where("length(text) < 60000 or text is null"), 4)
    assert ppm.scored(empty_documents(spark)).collect() == []


def test_the_shipped_order_with_a_long_text(spark):
    """Six bytes of context, and texts that fill several runs of positions."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(35_000))
    assert len(long) > 140_000
    rows = [(1, long), (2, long[:5000] + " other"), (3, None), (None, "word " * 300), (None, "word " * 300), (7, "A.")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), ppm.ORDER)


def test_values_of_asked_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 60, 500, np.uint64))
    values = rng.random(len(keys))
    for n in (1, 7, 5000):
        at = rng.integers(0, len(keys), n)
        assert (ppm._values_of(keys, values, keys[at]) == values[at]).all()


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    model = Plain(["".join(rng.choice("abc ") for _ in range(300)) for _ in range(5)], 3)
    for context in (b"\xfe\xfe\xfe", b"abc", b"zzz", b"zab", b"  a"):
        assert sum(model.probability(context, s) for s in range(256)) == pytest.approx(1)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string").withColumn("train", F.lit(False))
    row = ppm.score(docs, "train").first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (2, 0, 0)
    assert row["score"] == pytest.approx(-3 * math.log10(256))
    assert row["base_score"] == pytest.approx(0)


def test_many_blocks(spark, monkeypatch):
    """Blocks, buckets and runs of positions change nothing."""
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 500)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(50)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 5)


@pytest.mark.skipif(not HERE, reason="sample tables are not there")
def test_better_than_the_base(spark):
    found = ppm.scored(spark.read.parquet(f"{SF}/../sf0.1/documents.parquet")).where("held_out")
    row = found.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert row["score"] > 0.95 * row["base"]


def test_sums_of_texts():
    """More texts than are added up at a time, some of them empty."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(("ab", "abc", "zz", "q")) for _ in range(rng.choice((0, 1, 9)))).encode() for _ in range(600)]
    keys = ppm.gram_keys(texts, 6)
    values = np.random.default_rng(2).random(len(keys))
    found, n = ppm.grams(texts, 6)
    assert (keys == np.unique(found)).all()
    want = [part.sum() for part in np.split(values[np.searchsorted(keys, found)], np.cumsum(n)[:-1])]
    assert ppm.gram_sums(texts, 6, keys, values) == pytest.approx(want)


def test_memory_of_a_block(monkeypatch):
    """Counting the grams of a block holds its runs and little more (66 bytes a gram before, 31 now)."""
    monkeypatch.setattr(ppm, "_POSITIONS", 200_000)
    texts = list(np.random.default_rng(4).integers(97, 123, (40, 50_000), np.uint8).view("S50000").ravel())
    tracemalloc.start()
    try:
        keys, _ = ppm.gram_counts(texts, np.ones(len(texts), bool), 6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(keys) > 1_900_000
    assert peak < 50 * len(keys)
