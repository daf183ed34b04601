"""Best-fit packing of documents into token sequences after a Martello-Toth dominance reduction.

Which piece is which does not matter for a packing, only how many there are of each length, and there are at most
`capacity` lengths. So Spark counts the lengths, the packing is worked out on these counts, and Spark gives each
piece its place by its rank among the pieces of its length. However many documents there are, the counts stay small.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as _pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import pieces_of, ranked, stored, text_bytes

CAPACITY = 4096
END = 1
# Words a task remembers; beyond that it starts anew.
REMEMBERED = 1_200_000

# Words of these letters are unchanged by NFC and lower-cased letter by letter.
_SIMPLE = regex.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
# Fixed value: the pattern by which the vocabulary's tokenizer cuts words.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordIds:
    """Ids of texts by a tokenizer that cuts at white space and drops it, so each word is encoded once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        probe = "Ab, c's"
        if self._library([probe])[0] != b"".join(self._library(probe.split())):
            raise ValueError("the tokenizer does not drop white space")

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_pack(f"<{len(ids)}I", *ids) for ids in (one.ids for one in found)]

    def learn(self, new: set[bytes]) -> None:
        if len(self.parts) > self.remembered:
            self.parts.clear()
        # Words of a-z and A-Z are one part each.
        plain = {word: word.lower().decode() for word in new if word.isalpha()}
        cut: dict[bytes, list[str]] = {}
        whole: list[bytes] = []
        for word in new.difference(plain):
            text = word.decode()
            if "<|" not in text and _SIMPLE.fullmatch(text):
                cut[word] = _PARTS.findall(text.lower())
            else:
                whole.append(word)
        parts = list(set(plain.values()).union(*cut.values()).difference(self.parts))
        self.parts.update(zip(parts, self._library(parts), strict=True))
        known = self.parts.__getitem__
        self.words.update(zip(plain, map(known, plain.values()), strict=True))
        for word, found in cut.items():
            self.words[word] = b"".join(map(known, found))
        self.words.update(zip(whole, self._library([word.decode() for word in whole]), strict=True))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        cut = [text.split() for text in texts]
        known = self.words
        every = set().union(*cut)
        new = every.difference(known)
        if new:
            if len(known) + len(new) > self.remembered:
                known.clear()
                new = every
            self.learn(new)
        return [b"".join(map(known.__getitem__, found)) for found in cut]


@lru_cache(maxsize=1)
def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    return WordIds(path, remembered)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents over `capacity` ids are cut."""
    last = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path, remembered)
        for batch in pieces_of(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist()), strict=True):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class Plan:
    """A packing of so many items of each length: runs of equal items put into a row of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n}
        self.done = dict.fromkeys(counts, 0)
        self.sequences = 0
        # (length, first rank, items, items in each sequence, first sequence, offset)
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def put(self, length: int, items: int, each: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.done[length], items, each, sequence, offset))
        self.done[length] += items
        self.left[length] -= items
        if not self.left[length]:
            del self.left[length]

    def open(self, sequences: int) -> int:
        self.sequences += sequences
        return self.sequences - sequences

    def fix(self, longer: int, shorter: int) -> None:
        """Sequences of one `longer` and one `shorter` item, as many as there are."""
        n = self.left[longer] // 2 if longer == shorter else min(self.left[longer], self.left[shorter])
        if not n:
            return
        first = self.open(n)
        if longer == shorter:
            self.put(longer, 2 * n, 2, first, 0)
        else:
            self.put(longer, n, 1, first, 0)
            self.put(shorter, n, 1, first, longer)

    def reduce(self) -> None:
        """Fix sets of items that dominate every other set with their longest item: some best packing has them."""
        lengths = sorted(self.left)
        for length in reversed(list(lengths)):
            while self.left.get(length):
                n, room = self.left[length], self.capacity - length
                others = [x for x in self._smallest(lengths, length) if x <= room]
                if not others:  # nothing fits beside it
                    self.put(length, n, 1, self.open(n), 0)
                    break
                partner = self._largest(lengths, room, length)
                # Alone beside it only one item fits, or one fills the sequence, or one is as long as any two.
                single = len(others) == 1 or others[0] + others[1] > room
                fills = partner == room
                pairs = not single and not fills and (len(others) == 2 or sum(others[:3]) > room)
                if not (single or fills or (pairs and partner >= self._best_pair(lengths, room, length))):
                    break
                before = n
                self.fix(length, partner)
                if self.left.get(length, 0) == before:
                    break
            lengths = [x for x in lengths if x in self.left]

    def _smallest(self, lengths: list[int], length: int) -> list[int]:
        """The three shortest items beside one of `length`."""
        found: list[int] = []
        for x in lengths:
            found += [x] * min(3, self.left.get(x, 0) - (x == length))
            if len(found) >= 3:
                break
        return found[:3]

    def _largest(self, lengths: list[int], room: int, length: int) -> int:
        """The longest item that fits beside one of `length`."""
        at = bisect_left(lengths, room + 1) - 1
        while at >= 0 and self.left.get(lengths[at], 0) - (lengths[at] == length) <= 0:
            at -= 1
        return lengths[at] if at >= 0 else 0

    def _best_pair(self, lengths: list[int], room: int, length: int) -> int:
        """The greatest sum of two items that fit beside one of `length`."""
        there = [x for x in lengths if x <= room and self.left.get(x, 0) - (x == length) > 0]
        best, low, high = 0, 0, len(there) - 1
        while low <= high:
            total = there[low] + there[high]
            if total > room:
                high -= 1
                continue
            if low < high or self.left[there[low]] - (there[low] == length) > 1:
                best = max(best, total)
            low += 1
        return best

    def best_fit(self) -> None:
        """Longest items first, each into the fullest sequence that has room for it; equal items at once."""
        rooms: list[int] = []
        open_at: dict[int, list[tuple[int, int]]] = {}

        def add(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in open_at:
                    open_at[room] = []
                    insort(rooms, room)
                open_at[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    each = self.capacity // length
                    add(self.capacity, self.open(-(-n // each)), -(-n // each))
                    continue
                room = rooms[at]
                first, there = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
                each = room // length
                full = min(there, n // each)
                if full:
                    self.put(length, full * each, each, first, self.capacity - room)
                    add(room - each * length, first, full)
                    add(room, first + full, there - full)
                else:
                    self.put(length, n, n, first, self.capacity - room)
                    add(room - n * length, first, 1)
                    add(room, first + 1, there - 1)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    made = Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: one piece with the end token alone. Repeated rows are packed like others, a null doc_id stays
    null, an empty table gives no rows; columns other than doc_id and text are ignored.

    `remembered` bounds the words a task keeps in memory, not what it reads. The lengths' counts and the runs of the plan are small whatever the input is, and are broadcast.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, capacity, end, remembered), "pieces")
    # At most `capacity` rows.
    counts = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(
        plan(counts, capacity).runs,
        "run_length long, run_rank long, items long, each long, sequence long, run_offset long",
    )
    sizes = spark.createDataFrame(list(counts.items()), "of_length long, n long")
    counted = cut.join(F.broadcast(sizes), F.col("length") == F.col("of_length")).select(*cut.columns, "n")
    placed = ranked(counted, "length", "n", ["doc_id", "piece", "ids_crc32"])
    in_run = (
        (F.col("length") == F.col("run_length"))
        & (F.col("rank") >= F.col("run_rank"))
        & (F.col("rank") < F.col("run_rank") + F.col("items"))
    )
    nth = F.col("rank") - F.col("run_rank")
    return placed.join(F.broadcast(runs), in_run).select(
        *cut.columns,
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
