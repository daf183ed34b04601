"""LM scoring by prediction by partial matching: a byte-context trie with escapes and symbol exclusion.

How likely an escape is from a context of so many occurrences and different symbols is itself counted: each training
occurrence is left out in turn, and is an escape if its symbol is then new in its context.

A gram is a context of `order` bytes and the byte after it; the counts of shorter contexts follow from them. The trie
is never in one place. Documents stand in blocks; a block asks for each gram it has once. Counts are gathered by the
grams' hash, probabilities are worked out by the last bytes of the context, below which the trie's deeper contexts lie
together, and the answers go back to the blocks, which add them up per document. What is sent grows with the number of different
grams in the blocks, not with the positions. Word counts for the base score take the same way, without the trie.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import fold, stored, text_bytes, words

ORDER = 6
# Contexts up to this length are counted in one table for all tasks: at most 256 ** 3 numbers, whatever the input is.
SHORT = 2
BLOCK_BYTES = 24_000_000
BUCKET_BYTES = 16_000_000
_POSITIONS = 2_000_000
# Texts that are added up at a time: their numbers stand in the byte that a gram leaves free.
_AT_ONCE = 256
_START, _END = 0xFE, 0xFF  # bytes that UTF-8 never has
_SYMBOLS = 256
_END_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)
# Classes of contexts by occurrences and by symbols.
_MOST_N, _MOST_D = 40, 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """An array as compressed bytes, the first bytes of all numbers before the second ones."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Each key once, in order. The keys are sorted where they are."""
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _merged_runs(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key of some runs once, in order, with its counts added up; within a run no key is repeated.

    Only keys are sorted, and each run's counts are added where its keys then are, so nothing but the runs and one copy of their
    keys is held.
    """
    merged = _distinct(np.concatenate(keys))
    total = np.zeros(len(merged), np.int64)
    for k, c in zip(keys, counts, strict=True):
        total[np.searchsorted(merged, k)] += c
    return merged, total


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    found = ((keys * _SPREAD) >> np.uint64(33)) % np.uint64(n)
    # Few bytes a bucket: numbers of two bytes are sorted by their digits.
    return found.astype(np.uint16 if n <= 1 << 16 else np.int64)


def _dealt(keys: np.ndarray, values: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted keys and their values by where they go, each part still sorted."""
    order = np.argsort(to, kind="stable")
    ordered = to[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(to[part[0]]), keys[part], values[part]


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams at all positions of all texts, the end included, and the number of positions of each text."""
    pad = bytes([_START]) * order
    line = np.frombuffer(b"".join(pad + text + bytes([_END]) for text in texts), np.uint8)
    found = np.zeros(len(line) - order, np.uint64)
    for i in range(order + 1):
        found <<= np.uint64(8)
        found |= line[i : len(line) - order + i]
    return found[line[order:] != _START], np.array([len(text) + 1 for text in texts])


def _batches(texts: list[bytes], most: int | None = None) -> Iterator[slice]:
    """Runs of texts with about `_POSITIONS` bytes, and `most` texts at most."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= _POSITIONS or i + 1 - start == most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def gram_counts(texts: list[bytes], train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of the texts, and how often each is in a training text."""
    keys, counts = [], []
    for part in _batches(texts):
        found, n = grams(texts[part], order)
        found <<= np.uint64(1)
        found |= np.repeat(train[part], n)
        found.sort()
        learnt = (found & np.uint64(1)).astype(np.uint8)
        found >>= np.uint64(1)
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        keys.append(found[first])
        counts.append(np.add.reduceat(learnt, first, dtype=np.int32))
    return _merged_runs(keys, counts)


def gram_keys(texts: list[bytes], order: int) -> np.ndarray:
    """The different grams of the texts."""
    return _distinct(np.concatenate([_distinct(grams(texts[part], order)[0]) for part in _batches(texts)]))


def gram_sums(texts: list[bytes], order: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's grams, all of which are in `keys`.

    Grams are sorted together with the number of their text, so equal ones are looked up once and none has to go back to its place.
    """
    sums = []
    for part in _batches(texts, _AT_ONCE):
        found, n = grams(texts[part], order)
        found <<= np.uint64(8)
        found |= np.repeat(np.arange(len(n), dtype=np.uint8), n)
        found.sort()
        owner = (found & np.uint64(_AT_ONCE - 1)).astype(np.uint8)
        found >>= np.uint64(8)
        new = np.append(True, found[1:] != found[:-1])
        told = values[np.searchsorted(keys, found[new])]
        sums.append(np.bincount(owner, told[np.cumsum(new) - 1], len(n)))
    return np.concatenate(sums)


def _word_keys(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, and the end."""
    digests = b"".join(map(xxhash.xxh64_digest, text.split()))
    return np.append(np.frombuffer(digests, ">u8").astype(np.uint64), _END_WORD)


def word_counts(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for part in _batches(texts):
        found = [_word_keys(text) for text in texts[part]]
        joined = np.concatenate(found)
        keys.append(joined)
        counts.append(np.repeat(train[part].astype(np.int64), [len(x) for x in found]))
        keys[-1], counts[-1] = _summed(keys[-1], counts[-1])
    return _merged_runs(keys, counts)


class Level:
    """Counts of one context length: of each context and symbol, and of each context its total and its symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        contexts = keys >> np.uint64(8)
        self.first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = contexts[self.first]
        self.totals = np.add.reduceat(counts, self.first) if len(keys) else np.zeros(0, np.int64)
        self.symbols = np.diff(np.append(self.first, len(keys)))

    def shorter(self, length: int) -> Level:
        return Level(*_summed(self.keys & _mask(length), self.counts))


def _mask(length: int) -> np.uint64:
    return np.uint64((1 << (8 * (length + 1))) - 1)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key is, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _values_of(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key, all of which are in `keys`. Asked in order and once each, they are found side by side."""
    order = np.argsort(asked)
    ordered = asked[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    told = values[np.searchsorted(keys, ordered[new])]
    found = np.empty(len(asked), values.dtype)
    found[order] = told[np.cumsum(new) - 1]
    return found


def short_levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    found = {SHORT: Level(keys, counts)}
    for length in range(SHORT - 1, -1, -1):
        found[length] = found[length + 1].shorter(length)
    return found


def long_levels(keys: np.ndarray, counts: np.ndarray, order: int) -> dict[int, Level]:
    found = {order: Level(keys, counts)}
    for length in range(order - 1, SHORT, -1):
        found[length] = found[length + 1].shorter(length)
    return found


def _state(occurrences: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The class of a context by its occurrences (exact to 7, then by half octaves) and symbols (to 7, then octaves)."""
    n = np.where(occurrences < 8, occurrences, 4 + (2 * np.log2(np.maximum(occurrences, 1))).astype(np.int64))
    d = np.where(symbols < 8, symbols, 5 + np.log2(np.maximum(symbols, 1)).astype(np.int64))
    return np.minimum(n, _MOST_N - 1) * _MOST_D + np.minimum(d, _MOST_D - 1)


def escape_tally(level: Level) -> np.ndarray:
    """How often an occurrence that is left out is an escape (row 0) or not (row 1), by the class of what is left."""
    tally = np.zeros((2, _MOST_N * _MOST_D))
    if len(level.keys):
        once = np.add.reduceat((level.counts == 1).astype(np.int64), level.first)
        several = level.totals > 1
        total, symbols, once = level.totals[several], level.symbols[several], once[several]
        np.add.at(tally[0], _state(total - 1, symbols - 1), once)
        np.add.at(tally[1], _state(total - 1, symbols), total - once)
    return tally


def escape_rates(tally: np.ndarray) -> np.ndarray:
    return (tally[0] + 0.5) / (tally[0] + tally[1] + 1)


def log_probabilities(asked: np.ndarray, levels: dict[int, Level], rates: dict[int, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each asked gram's last byte after its context.

    From the longest context down: a symbol seen there gets its share of what the escape leaves; otherwise the escape is
    taken to the next shorter context, in which the symbols of the longer one are left out. After the empty context
    all symbols left are equally likely.
    """
    order = max(levels)
    result, done = np.zeros(len(asked)), np.zeros(len(asked), bool)
    for length in range(order, -1, -1):
        level = levels[length]
        total, symbols = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        if len(level.keys):
            at, there = _found(level.contexts, (asked & _mask(length)) >> np.uint64(8))
            total, symbols = np.where(there, level.totals[at], 0), np.where(there, level.symbols[at], 0)
        longer = levels.get(length + 1)
        if longer is not None and len(longer.keys):
            here, _ = _found(level.keys, longer.keys & _mask(length))
            excluded = np.add.reduceat(level.counts[here], longer.first)
            at, there = _found(longer.contexts, (asked & _mask(length + 1)) >> np.uint64(8))
            total = total - np.where(there, excluded[at], 0)
            symbols = symbols - np.where(there, longer.symbols[at], 0)
        rate = rates[length][_state(total, symbols)]
        at, seen = _found(level.keys, asked & _mask(length))
        hit = seen & ~done
        if hit.any():
            result[hit] += np.log10((1 - rate[hit]) * level.counts[at[hit]] / total[hit])
        escape = ~seen & ~done & (total > 0)
        result[escape] += np.log10(rate[escape])
        done |= seen
    result[~done] -= np.log10(max(1, _SYMBOLS - len(levels[0].keys)))
    return result


def score(docs: DataFrame, train: str, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    `train` names a boolean column: the rows to learn from. Texts are lower-cased (A-Z) words with one space between and
    an end; a null text is empty and has the end only. `score` is the log10 probability of these bytes, `base_score`
    that of the tokens by their smoothed counts. Repeated rows are learnt and scored like others, a null doc_id stays
    null, an empty table gives no rows. Without training rows every byte is equally likely. Columns other than doc_id,
    text and `train` are ignored.
    """
    if not SHORT < order <= 6:
        raise ValueError(f"the order must be from {SHORT + 1} to 6")
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(8, -(-total // BUCKET_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents in blocks, and each block's different grams and words with their training counts."""
        part, block = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        flags: list[bool] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name, learnt = (part << 24) + block, np.array(flags, bool)
            # Documents in batches of a few MB, compressed together.
            for some in _batches(texts):
                yield _rows([name], ["doc"], [0], [zstandard.compress(pickle.dumps((ids[some], texts[some])), 3)], [b""])
            for kind, (keys, counts) in (("gram", gram_counts(texts, learnt, order)), ("word", word_counts(texts, learnt))):
                for bucket, k, c in _dealt(keys, counts, _buckets(keys, buckets)):
                    yield _rows([name], [kind], [bucket], [packed_keys(k)], [packed(c)])

        for batch in batches:
            for doc_id, text, flag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(b" ".join(words(text.as_py())))
                flags.append(bool(flag))
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield from flush()
                    ids, texts, flags, held, block = [], [], [], 0, block + 1
        if ids:
            yield from flush()

    shape = "block long, kind string, bucket long, keys binary, counts binary"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.col(train).alias("train"))
    asked = stored(source.mapInArrow(ask, shape), "asked", compression="zstd")

    def gather(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        """Words: the counts, back to the blocks. Grams: each once with its count, to the part of the trie it is in."""
        kind, bucket = key[0].as_py(), key[1].as_py()
        parts = [unpacked_keys(x.as_py()) for x in found.column("keys")]
        keys, counts = _merged_runs(parts, [unpacked(x.as_py(), "<i8") for x in found.column("counts")])
        rows: list[tuple] = []
        if kind == "word":
            rows.append(("words", bucket, b"", b"", int(counts.sum()), int((counts > 0).sum())))
            for block, part in zip(found.column("block").to_pylist(), parts, strict=True):
                rows.append(("word", block, b"", packed(counts[_found(keys, part)[0]]), bucket, 0))
        else:
            low, n = _summed(keys[counts > 0] & _mask(SHORT), counts[counts > 0])
            rows.append(("short", bucket, packed_keys(low), packed(n), 0, 0))
            stem = (keys >> np.uint64(8)) & np.uint64(0xFFFFFF)
            for place, k, c in _dealt(keys, counts, _buckets(stem, buckets)):
                rows.append(("trie", place, packed_keys(k), packed(c), 0, 0))
        return _table(rows)

    gathered_shape = "kind string, place long, keys binary, counts binary, tokens long, known long"
    gathered = stored(
        asked.where("kind <> 'doc'").select("kind", "bucket", "block", "keys", "counts").groupBy("kind", "bucket").applyInArrow(gather, gathered_shape),
        "gathered",
    )
    sums = gathered.where("kind = 'words'").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    tokens, vocabulary = sums["n"], sums["v"]

    # Bounded: at most 256 ** (SHORT + 1) keys.
    def merge(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        keys, counts = _merged(found)
        return pa.table({"keys": pa.array([packed_keys(keys)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary())})

    some = gathered.where("kind = 'short'").select((F.col("place") % 16).alias("part"), "keys", "counts")
    merged = some.groupBy("part").applyInArrow(merge, "keys binary, counts binary").collect()
    parts = [(unpacked_keys(row["keys"]), unpacked(row["counts"], "<i8")) for row in merged] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    lowest = short_levels(*_summed(*(np.concatenate(x) for x in zip(*parts, strict=True))))
    trie = gathered.where("kind = 'trie'").select("place", "keys", "counts")

    def tally(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        keys, counts = _merged(found)
        levels = long_levels(keys[counts > 0], counts[counts > 0], order)
        tallies = [escape_tally(levels[length]).ravel().tolist() for length in range(SHORT + 1, order + 1)]
        return pa.table({"length": list(range(SHORT + 1, order + 1)), "tally": pa.array(tallies, pa.list_(pa.float64()))})

    # One small table for each context length.
    width = 2 * _MOST_N * _MOST_D
    added = (
        trie.groupBy("place").applyInArrow(tally, "length long, tally array<double>")
        .select("length", F.posexplode("tally")).groupBy("length", "pos").agg(F.sum("col").alias("n"))
    )
    tallies = {length: np.zeros(width) for length in range(SHORT + 1, order + 1)}
    for row in added.where("n > 0").collect():
        tallies[row["length"]][row["pos"]] = row["n"]
    rates = {length: escape_rates(x.reshape(2, -1)) for length, x in tallies.items()}
    rates |= {length: escape_rates(escape_tally(level)) for length, level in lowest.items()}
    short = spark.sparkContext.broadcast((lowest, rates))

    def predict(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        """Probabilities of all grams in one part of the trie, back to the grams' buckets."""
        keys, counts = _merged(found)
        lowest, rates = short.value
        found_logs = log_probabilities(keys, lowest | long_levels(keys[counts > 0], counts[counts > 0], order), rates)
        rows = [(bucket, packed_keys(k), packed(v)) for bucket, k, v in _dealt(keys, found_logs.astype("<f4"), _buckets(keys, buckets))]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("bucket", pa.int64()), ("keys", pa.binary()), ("logs", pa.binary())))})

    model = stored(trie.groupBy("place").applyInArrow(predict, "bucket long, keys binary, logs binary"), "model")

    def answer(key: tuple[pa.Scalar, ...], requests: pa.Table, known: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x.as_py()) for x in known.column("keys")]
        logs = [unpacked(x.as_py(), "<f4") for x in known.column("logs")]
        keys, logs = np.concatenate(keys), np.concatenate(logs)
        order_ = np.argsort(keys)
        keys, logs = keys[order_], logs[order_]
        answers = [packed(logs[_found(keys, unpacked_keys(x.as_py()))[0]]) for x in requests.column("keys")]
        return pa.table({"block": requests.column("block"), "bucket": requests.column("bucket"), "told": pa.array(answers, pa.binary())})

    requests = asked.where("kind = 'gram'").select("bucket", "block", "keys")
    answers = (
        requests.groupBy("bucket")
        .cogroup(model.groupBy("bucket"))
        .applyInArrow(answer, "block long, bucket long, told binary")
        .select("block", F.lit("gram").alias("kind"), "bucket", "told")
    )
    told_words = gathered.where("kind = 'word'").select(F.col("place").alias("block"), "kind", F.col("tokens").alias("bucket"), F.col("counts").alias("told"))

    def add_up(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        ids: list = []
        raw: list[bytes] = []
        for batch in texts.column("keys"):
            some_ids, some_texts = pickle.loads(zstandard.decompress(batch.as_py()))
            ids += some_ids
            raw += some_texts
        # The answers have no keys: they are in the order in which the block's keys were asked for.
        def told_for(kind: str, number: str, asked_keys: np.ndarray) -> np.ndarray:
            rows = told.filter(pc.equal(told.column("kind"), kind)).sort_by("bucket")
            by_key = np.empty(len(asked_keys), number)
            order_ = np.argsort(_buckets(asked_keys, buckets), kind="stable")
            start = 0
            for answer in rows.column("told"):
                found = unpacked(answer.as_py(), number)
                by_key[order_[start : start + len(found)]] = found
                start += len(found)
            return by_key

        keys = gram_keys(raw, order)
        scores = gram_sums(raw, order, keys, told_for("gram", "<f4", keys))
        of_words = [_word_keys(text) for text in raw]
        keys = _distinct(np.concatenate(of_words))
        counts = told_for("word", "<i8", keys)
        columns: list[list] = [[], [], []]
        for part in _batches(raw):
            n = np.array([len(x) for x in of_words[part]])
            ends = np.append(0, np.cumsum(n)[:-1])
            seen = _values_of(keys, counts, np.concatenate(of_words[part]))
            columns[0].append(n)
            columns[1].append(np.add.reduceat((seen > 0).astype(np.int64), ends))
            columns[2].append(np.add.reduceat(np.log10((seen + 0.5) / (tokens + 0.5 * (vocabulary + 1))), ends))
        done = [np.concatenate(x) for x in columns]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": done[0].astype(np.int64), "n_known": done[1], "base_score": done[2], "score": scores})

    scored = (
        asked.where("kind = 'doc'")
        .select("block", "keys")
        .groupBy("block")
        .cogroup(answers.unionByName(told_words).groupBy("block"))
        .applyInArrow(add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _merged(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpacked_keys(x.as_py()) for x in found.column("keys")]
    counts = [unpacked(x.as_py(), "<i8") for x in found.column("counts")]
    return _merged_runs(keys, counts)


def _rows(*columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
    names = ["block", "kind", "bucket", "keys", "counts"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = ("kind", "place", "keys", "counts", "tokens", "known")
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """`score` learning from the documents whose fold of five is not 1, with held_out for the others."""
    found = score(docs.select("doc_id", "text", (fold(5) != 1).alias("train")), "train", order)
    return found.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
