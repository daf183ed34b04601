import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from llm_cases import HERE, SF, empty_documents, odd_documents
from tokenizers import Tokenizer

from saleslake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""

    @lru_cache(maxsize=None)
    def best(left, rooms):
        if not left:
            return len(rooms)
        size, rest = left[0], left[1:]
        options = [best(rest, tuple(sorted((*rooms, capacity - size))))]
        for room in set(rooms):
            if room >= size:
                others = list(rooms)
                others.remove(room)
                options.append(best(rest, tuple(sorted((*others, room - size)))))
        return min(options)

    return best(tuple(sorted(sizes, reverse=True)), ())


def test_plans_are_whole_and_short():
    rng = random.Random(4)
    longer = 0
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        made = packing.plan(dict(counts), capacity)
        seen, used = Counter(), defaultdict(list)
        for length, first, items, each, sequence, offset in made.runs:
            assert first == seen[length]
            seen[length] += items
            for i in range(items):
                used[sequence + i // each].append((offset + i % each * length, length))
        assert seen == counts
        assert sorted(used) == list(range(made.sequences))
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        best = fewest(tuple(counts.elements()), capacity)
        assert made.sequences <= best + 1
        longer += made.sequences > best
    assert longer <= 3


def test_reduction_alone_is_optimal():
    """What the reduction fixes never costs a sequence."""
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([10, 20])
        counts = Counter(rng.randint(2, capacity) for _ in range(rng.randint(2, 8)))
        made = packing.Plan(dict(counts), capacity)
        made.reduce()
        left = tuple(x for x, n in made.left.items() for _ in range(n))
        assert made.sequences + (fewest(left, capacity) if left else 0) == fewest(tuple(counts.elements()), capacity)


def check(rows, texts, library):
    of_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 4096) + max(2, len(sequences) // 50)


def test_odd_documents(spark, library):
    docs = odd_documents(spark)
    check(packing.pack(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library)
    assert packing.pack(empty_documents(spark), PATH).collect() == []


def test_one_length_in_most_rows(spark, library):
    rows = [(i, "same words here" if i % 3 else f"other {i} " * (i % 40)) for i in range(900)]
    check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect(), rows, library)


def test_random_words(library):
    rng = random.Random(6)
    parts = ["a", "b", " ", "\n", "é", "É", "<|endoftext|>", "<|start", "ß", "İ", "日本", "́", "e", "😀", "\x00", "THE", ".", "'s", "'RE", "12", "\x85", "\xa0", "Σ", "ﬁ", "½"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    found = packing.word_ids(PATH).ids([t.encode() for t in texts])
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.skipif(not HERE, reason="sample tables are not there")
def test_sample(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.pack(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library)
