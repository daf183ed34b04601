"""Toxicity by noisy-channel deobfuscation.

Words that look disguised are lattices: a sign may be a letter it stands for or nothing, a repeated letter may be one
letter, single letters with gaps may be one word. The Viterbi path under a character model of the corpus restores
them. The restored text is scored by a logistic regression on its words and their beginnings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import fold, pieces_of, stored, text_bytes
from saleslake.llm.ppm import packed, unpacked
from saleslake.operators.joins import lookup_join

THRESHOLD = 0.3
# The regression is fitted on about this many labelled rows at most; all of them are counted to choose its features.
SAMPLE = 20_000
# Features of the model at most, and the chi-square that each must exceed: one in some 5,000 does by chance.
FEATURES = 2048
_LEAST_GAIN = 14.0
BUCKETS = 1 << 20
_BUCKET = BUCKETS - 1
_SLICES = 64
REMEMBERED = 150_000
# Tokens whose features are remembered; most have none, so just the token is kept.
KNOWN_TOKENS = 400_000
# Texts that are looked at together, in number and in bytes.
_TEXTS, _TEXT_BYTES = 256, 1_000_000

# Letters of the character model: a-z and the letters of Latin-1; anything else ends a word.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ"
_N = 64
# What signs may stand for.
_STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "¢": "c", "#": "h",
}
_MASKS = "*_"
# Costs in natural logarithms.
_SIGN, _MASKED, _DROPPED, _REPEATED, _BORDER = 1.5, 3.0, 4.0, 0.7, 1.0

_EDGE = ".,;:!?\"'()[]{}|%#&*-_~^`…«»“”‘’/\\<>="
_PLAIN_EDGE = "".join(x for x in _EDGE if x not in _STANDS_FOR)
_ENDS = _EDGE + "".join(x for x in _STANDS_FOR if not x.isalnum())
_ODD = re.compile(r"[^\W\d_]*?(?:[\d@$!|+€£(¡¢#*_.\-]|([^\W\d_])\1)")
_TWICE = re.compile(r"(.)\1").search
_STOPS = ".,;:?"
_SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]{1,2}[^\s.\-_*]){2,}(?![^\s.,;:!?\"')\]])")
_WORD = re.compile(r"[^\W\d_]+")


def letter_codes() -> np.ndarray:
    """Code of each character below 256 in the character model, 0 for what is no letter."""
    codes = np.zeros(257, np.int64)
    for i, letter in enumerate(_LETTERS, 1):
        codes[ord(letter)] = i
        if len(letter.upper()) == 1 and ord(letter.upper()) < 256:
            codes[ord(letter.upper())] = i
    return codes


def trigrams(text: bytes, codes: np.ndarray) -> np.ndarray:
    """Letters with the two before them, word borders included, as one number each."""
    points = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    line = np.concatenate([[0, 0], codes[np.minimum(points, 256)], [0]])
    found = (line[:-2] * _N + line[1:-1]) * _N + line[2:]
    return found[(line[1:-1] > 0) | (line[2:] > 0)]


def character_counts(docs: DataFrame) -> np.ndarray:
    """How often each letter follows each two letters, over all whole texts: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = letter_codes(), np.zeros(_N**3, np.int64)
        for batch in pieces_of(batches):
            # Two line ends between texts are two word borders, as at the ends of each text.
            counts += np.bincount(trigrams(b"\n\n".join(batch.column(0).to_pylist()), codes), minlength=_N**3)
        first = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(first % _SLICES), pa.array(first), pa.array(counts[first])], names=["slice", "gram", "n"])

    found = docs.select(text_bytes()).mapInArrow(count, "slice long, gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = np.zeros(_N**3, np.int64)
    for row in found.collect():  # at most 64 ** 3 rows
        table[row["gram"]] = row["n"]
    return table


class Restorer:
    """Restores disguised words under a character model."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(_N, _N, _N).astype(np.float64)
        one = cube.sum((0, 1)) + 0.1
        two = cube.sum(0) + 4 * one / one.sum()
        two /= two.sum(1, keepdims=True)
        three = cube + 4 * two[None]
        self.cost = -np.log(three / three.sum(2, keepdims=True))
        self.flat = self.cost.ravel().tolist()
        self.code = {letter: i for i, letter in enumerate(_LETTERS, 1)}
        self.known: dict[str, tuple[str, ...]] = {}

    def decode(self, signs: str, borders: bool = False) -> str:
        """The likeliest word behind the signs, or with `borders` the likeliest words, with a blank between."""
        # Best cost and word for each pair of last letters (as one number).
        flat, code = self.flat, self.code
        paths: dict[int, tuple[float, str]] = {0: (0.0, "")}
        before = ""
        for sign in signs:
            if sign in code:
                choices = [(sign, code[sign], 0.0)]
                drop = _REPEATED if sign == before else None
            else:
                letters, price = (_LETTERS[:26], _MASKED) if sign in _MASKS else (_STANDS_FOR.get(sign, ""), _SIGN)
                choices = [(x, code[x], price) for x in letters]
                drop = _DROPPED if choices else 0.0
            before = sign
            step: dict[int, tuple[float, str]] = {}
            if drop is not None:
                step = {pair: (cost + drop, word) for pair, (cost, word) in paths.items()}
            for pair, (cost, word) in paths.items():
                last = pair % _N * _N
                for letter, c, price in choices:
                    total = cost + price + flat[pair * _N + c]
                    best = step.get(last + c)
                    if best is None or total < best[0]:
                        step[last + c] = (total, word + letter)
            if borders:
                for pair, (cost, word) in list(step.items()):
                    total = cost + _BORDER + flat[pair * _N]
                    best = step.get(pair % _N * _N)
                    if pair % _N and (best is None or total < best[0]):
                        step[pair % _N * _N] = (total, word + " ")
            paths = step
        ends = [(cost + flat[pair * _N], word) for pair, (cost, word) in paths.items() if pair % _N or not word]
        return min(ends)[1] if ends else ""

    def words(self, token: str) -> tuple[str, ...]:
        """The words of a lower-cased token, the restored one included."""
        if not _TWICE(token):
            if token.isalpha():
                return (token,)
            if token[:-1].isalpha() and token[-1] in _STOPS:
                return (token[:-1],)
        known = self.known.get(token)
        if known is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = _WORD.findall(token)
            # Signs at the end are letters in one reading and no part of the word in another; both count.
            for core in dict.fromkeys((token.strip(_EDGE), token.lstrip(_PLAIN_EDGE).rstrip(_EDGE), token.rstrip(_ENDS))):
                if self._may_hide(core):
                    found.append(self.decode(core))
            known = self.known[token] = tuple(x for x in dict.fromkeys(found) if x)
        return known

    @staticmethod
    def _may_hide(core: str) -> bool:
        """Two letters and a sign or repeated letter, or one letter and signs that all stand for letters; a number is a number."""
        letters = sum(x.isalpha() for x in core)
        if letters >= 2:
            return bool(_ODD.match(core))
        return letters == 1 and len(core) >= 3 and all(x.isalpha() or x in _STANDS_FOR for x in core)

    def spaced(self, text: str) -> list[str]:
        """Words written as single letters with gaps; several in a row are told apart by the character model."""
        return [word for x in _SPACED.findall(text) for word in self.decode(re.sub(r"[\s.\-_*]", "", x), True).split()]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()
_WHOLE = crc32(b"=")


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the word that each feature belongs to, and the features: hashes of the word and its beginnings of three to nine bytes.

    All words are hashed together, byte by byte, which takes a tenth of the time that a loop over their beginnings does.
    """
    raw = [word.encode() for word in words]
    n = len(raw)
    size = np.fromiter(map(len, raw), np.int64, n)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(raw), np.uint8)
    found = [np.fromiter((crc32(x, _WHOLE) for x in raw), np.uint32, n)]
    owner = [np.arange(n)]
    at, crc = owner[0], np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(9):
        longer = size[at] > i
        at, crc = at[longer], crc[longer]
        crc = _CRC[(crc ^ flat[start[at] + i]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        if i >= 2:
            found.append(~crc)
            owner.append(at)
    return np.concatenate(owner), np.concatenate(found) & np.uint32(_BUCKET)


def _groups(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts to look at together."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= _TEXT_BYTES or i + 1 - start == _TEXTS:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, width: int, turns: int = 2000, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on rows with the given columns set.

    Plain gradient steps, so what many toxic rows share, such as the beginning of a word, takes the weight before
    what few have, such as the whole word, and a word that was never seen is known by its beginning.
    """
    n = len(labels)
    rate = (labels.sum() + 0.5) / (n + 1)
    weights, shift = np.zeros(width), float(np.log(rate / (1 - rate)))
    if not n or not len(rows):
        return weights, shift
    size = np.bincount(rows, minlength=n)
    step = 1 / (0.25 * np.bincount(columns, size[rows], width).max() + ridge)
    speed, shift_speed = np.zeros(width), 0.0
    for _ in range(turns):
        off = labels - 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights[columns], n) + shift, -30, 30)))
        speed = 0.9 * speed + step * (np.bincount(columns, off[rows], width) - ridge * weights)
        shift_speed = 0.9 * shift_speed + 0.4 * off.sum() / n
        weights = weights + speed
        shift += shift_speed
    return weights, shift


class Scorer:
    """Scores texts by restored words with chosen features."""

    def __init__(self, counts: np.ndarray, chosen: np.ndarray, weights: np.ndarray, shift: float):
        self.counts, self.chosen, self.weights, self.shift = counts, chosen, weights, shift
        # Tokens without a chosen feature, and the places of the others'.
        self.plain: set[str] = set()
        self.known: dict[str, tuple[int, ...]] = {}

    @cached_property
    def restorer(self) -> Restorer:
        return Restorer(self.counts)

    @cached_property
    def place(self) -> np.ndarray:
        """The place of each feature among the chosen ones, -1 for others."""
        found = np.full(BUCKETS, -1, np.int32)
        found[self.chosen] = np.arange(len(self.chosen))
        return found

    def __getstate__(self) -> tuple:
        return self.counts, self.chosen, self.weights, self.shift

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def forget(self) -> None:
        self.plain.clear()
        self.known.clear()
        self.restorer.known.clear()

    def _places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' chosen features: the number of the word that each belongs to, and its place."""
        owner, features = features_of(words)
        places = self.place[features]
        chosen = places >= 0
        return owner[chosen], places[chosen]

    def _learn(self, tokens: set[str]) -> None:
        """Find the places of tokens that are not remembered."""
        numbered = list(tokens)
        of_token = [self.restorer.words(token) for token in numbered]
        token = np.repeat(np.arange(len(numbered)), np.fromiter(map(len, of_token), np.int64, len(numbered)))
        owner, places = self._places([word for words in of_token for word in words])
        found: dict[int, set[int]] = {}
        for i, at in zip(token[owner].tolist(), places.tolist(), strict=True):
            found.setdefault(i, set()).add(at)
        known = {numbered[i]: tuple(at) for i, at in found.items()}
        self.known.update(known)
        self.plain.update(tokens.difference(known))

    def active(self, texts: list[str]) -> list[set[int]]:
        """Places of the chosen features that each text has."""
        lowered = [text.lower() for text in texts]
        tokens = [set(text.split()) for text in lowered]
        every = set().union(*tokens)
        if len(self.plain) + len(self.known) > KNOWN_TOKENS:
            self.plain.clear()
            self.known.clear()
        self._learn(every.difference(self.plain).difference(self.known))
        known, plain = self.known, self.plain
        result = [{at for token in of_text.difference(plain) for at in known[token]} for of_text in tokens]
        spaced = [(i, word) for i, text in enumerate(lowered) for word in self.restorer.spaced(text)]
        owner, places = self._places([word for _, word in spaced])
        for i, at in zip(owner.tolist(), places.tolist(), strict=True):
            result[spaced[i][0]].add(at)
        return result

    def scores(self, texts: list[str]) -> list[float]:
        totals = [self.shift + float(sum(self.weights[i] for i in sorted(active))) for active in self.active(texts)]
        return [float(1 / (1 + np.exp(-np.clip(total, -30, 30)))) for total in totals]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def _choose(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The features that speak for toxicity most clearly, by chi-square: text beside an insult is no excuse for it."""
    n = n_toxic + n_clean
    seen = toxic + clean
    if not n_toxic or not n_clean:
        return np.zeros(0, np.int64)
    expected = seen * (n_toxic / n)
    spread = seen * (n_toxic / n) * (n_clean / n) * (1 - seen / n) + 0.5
    gain = (toxic - expected) ** 2 / spread
    gain[(toxic < 2) | (toxic <= expected)] = 0
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    return np.sort(best[gain[best] > _LEAST_GAIN])


def _all_features(restorer: Restorer, texts: list[bytes]) -> list[np.ndarray]:
    """The features of each text, once and in order."""
    lowered = [text.decode().lower() for text in texts]
    # Distinct tokens of all texts, each with its words, and after them the words written with gaps.
    number: dict[str, int] = {}
    at = [[number.setdefault(token, len(number)) for token in set(text.split())] for text in lowered]
    of_token = [restorer.words(token) for token in number]
    for mine, text in zip(at, lowered, strict=True):
        for word in restorer.spaced(text):
            mine.append(len(of_token))
            of_token.append((word,))
    token = np.repeat(np.arange(len(of_token)), np.fromiter(map(len, of_token), np.int64, len(of_token)))
    owner, features = features_of([word for words in of_token for word in words])
    order = np.argsort(token[owner], kind="stable")
    features, n = features[order], np.bincount(token[owner], minlength=len(of_token))
    first = np.cumsum(n) - n
    found = []
    for mine in at:
        mine = np.array(mine, np.int64)
        size = n[mine]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found.append(np.unique(features[np.repeat(first[mine], size) + inside]))
    return found


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer fitted on the labelled documents whose fold of four is not 2.

    `labels` has doc_id and toxic; of several labels of one document the highest counts, null ones do not.
    The character model is counted over all documents, the features over all labelled rows for training. The
    weights are fitted on a sample of these, drawn by the hash of doc_id.
    """
    spark = docs.sparkSession
    counts = character_counts(docs)
    usable = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    usable = stored(usable.where(fold(4) != 2), "labels")
    share = min(1.0, sample / max(1, usable.count()))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    drawn = (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(share * 1_000_003)).alias("drawn")
    learnt = lookup_join(plain, usable, "doc_id", "inner", ["doc_id"]).select("text", "toxic", drawn)
    model = spark.sparkContext.broadcast(Scorer(counts, np.zeros(0, np.int64), np.zeros(0), 0.0))
    names = ["slice", "toxic", "n", "found"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of drawn rows (slice -1), and for all rows how many have each feature."""
        restorer = model.value.restorer
        have, n = np.zeros((2, BUCKETS), np.int32), [0, 0]
        for batch in pieces_of(batches, _TEXTS):
            texts, labels, drawn = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for some in _groups(texts):
                for found, toxic, keep in zip(_all_features(restorer, texts[some]), labels[some], drawn[some], strict=True):
                    label = int(toxic > 0)
                    have[label, found] += 1
                    n[label] += 1
                    if keep:
                        rows.append((-1, label, 1, packed(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        restorer.known.clear()  # the worker lives on
        for label in (0, 1):
            if n[label]:
                slices = [(i, label, n[label] if not i else 0, packed(np.ascontiguousarray(part))) for i, part in enumerate(np.split(have[label], _SLICES))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*slices, strict=True), kinds, strict=True)], names=names)

    looked = stored(learnt.mapInArrow(look, "slice long, toxic long, n long, found binary"), "looked")

    def add(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        total = sum(unpacked(x.as_py(), "<i4").astype(np.int64) for x in found.column("found"))
        n = sum(found.column("n").to_pylist())
        return pa.table({"slice": [key[0].as_py()], "toxic": [key[1].as_py()], "n": [n], "found": pa.array([packed(total)], pa.binary())})

    summed = looked.where("slice >= 0").groupBy("slice", "toxic").applyInArrow(add, "slice long, toxic long, n long, found binary")
    have, n = np.zeros((2, _SLICES, BUCKETS // _SLICES), np.int64), [0, 0]
    for row in summed.collect():  # two rows for each slice
        have[row["toxic"], row["slice"]] = unpacked(row["found"], "<i8")
        n[row["toxic"]] += row["n"]
    chosen = _choose(have[1].ravel(), have[0].ravel(), n[1], n[0])
    wanted = spark.sparkContext.broadcast(chosen)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpacked(x.as_py(), "<u4") for x in batch.column(1)]
            places = [np.flatnonzero(np.isin(wanted.value, x)).astype(np.int32).tolist() for x in found]
            yield pa.record_batch([batch.column(0), pa.array(places, pa.list_(pa.int32()))], names=["toxic", "places"])

    rows = looked.where("slice = -1").select("toxic", "found").mapInArrow(keep, "toxic long, places array<int>").collect()
    rows = sorted((row["toxic"], row["places"]) for row in rows)  # the same order at each run
    owner = np.repeat(np.arange(len(rows)), [len(places) for _, places in rows]) if rows else np.zeros(0, np.int64)
    places = np.concatenate([np.array(places, np.int64) for _, places in rows]) if rows else np.zeros(0, np.int64)
    weights, shift = fit(owner, places, np.array([toxic for toxic, _ in rows], float), len(chosen))
    return Scorer(counts, chosen, weights, shift)


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with all their columns in a struct `doc`, and score and predicted for each."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value
        for texts in batches:
            raw = [bytes(text) for text in texts]
            yield pd.Series([x for some in _groups(raw) for x in scorer.scores([text.decode() for text in raw[some]])], dtype=float)
        scorer.forget()  # the worker lives on

    found = docs.select(F.struct("*").alias("doc"), scored(text_bytes()).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out (fold of four is 2), score, predicted.

    A null or empty text has the score of a text without any feature. Repeated rows are scored alike, a null doc_id stays
    null and has no label, an empty table gives no rows. Without labels of both kinds every text has the same score. Only
    texts and the labels for training enter a score.
    """
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return found.select("doc.doc_id", "score", "predicted").select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, with all their columns.

    A null text is empty and scores like an empty one. Null ids and repeated rows are rows like others. Without usable labels every
    document scores one half, which is above the threshold, so nothing stays. An empty table stays empty.
    """
    return score(docs, train(docs, labels)).where("predicted = 0").select("doc.*")
