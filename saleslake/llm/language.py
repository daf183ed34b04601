"""Language identification by Bayesian fusion of evidence.

The text's likelihood under n-gram models of the languages is combined with what the markup declares, the suffix of the
address, and a prior of the host that is smoothed by its domain's and this by all rows'. All of these are counted by grouped
aggregation over the whole table; a row's own vote is taken out of its host's counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import stored, text_bytes
from saleslake.llm.html import Page, host
from saleslake.llm.ppm import packed, unpacked
from saleslake.operators.joins import lookup_join

# No known language: every n-gram is equally likely.
UNKNOWN = "und"
BUCKETS = 1 << 16
_SPREAD = np.uint32(2654435761)
# Overlapping n-grams are not independent: a text counts as this many of them at most, however long it is.
_WEIGHT = 50.0
# Pseudo-counts: of each n-gram; of the host's domain, and of all rows for a domain; of each declared value and suffix.
_ALPHA, _HOST, _DOMAIN, _PAIR = 0.5, 5.0, 20.0, 0.5
_UNKNOWN_PRIOR = 1e-3
_AT_ONCE = 1 << 20


def _byte_classes() -> np.ndarray:
    """Letters as they are (A-Z in lower case), other ASCII as a space, bytes of other characters as they are."""
    classes = np.full(256, 32, np.uint8)
    classes[97:123] = np.arange(97, 123)
    classes[65:91] = np.arange(97, 123)
    classes[128:] = np.arange(128, 256)
    return classes


_CLASSES = _byte_classes()


def ngrams(text: bytes) -> np.ndarray:
    """Buckets of the four-byte n-grams of a text's words, in lower case, with one space between and around them."""
    line = _CLASSES[np.frombuffer(b" " + text.decode().lower().encode() + b" ", np.uint8)]
    line = line[np.append(True, (line[1:] != 32) | (line[:-1] != 32))].astype(np.uint32)
    if len(line) < 3:  # spaces alone
        return np.zeros(0, np.uint32)
    if len(line) == 3:  # a word of one letter
        line = np.append(line, np.uint32(32))
    found = (line[:-3] << np.uint32(24)) | (line[1:-2] << np.uint32(16)) | (line[2:-1] << np.uint32(8)) | line[3:]
    return (found * _SPREAD) >> np.uint32(16)


class Model:
    """n-gram log likelihoods of languages; the last one is the unknown."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = [*sorted(counts), UNKNOWN]
        table = np.stack([counts[x] for x in self.languages[:-1]] + [np.zeros(BUCKETS)]) + _ALPHA
        self.logs = np.log(table / table.sum(1, keepdims=True))

    def means(self, text: bytes) -> tuple[list[float], int]:
        """Mean log likelihood of an n-gram under each language, and the number of n-grams."""
        found = ngrams(text)
        total = np.zeros(len(self.languages))
        for start in range(0, len(found), _AT_ONCE):
            total += self.logs[:, found[start : start + _AT_ONCE]].sum(1)
        return (total / max(1, len(found))).tolist(), len(found)


def train(docs: DataFrame) -> Model:
    """Models of all languages that documents (text, lang) name; a null lang teaches nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                of = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                found = ngrams(text.as_py())
                if len(found) < BUCKETS // 8:
                    np.add.at(of, found, 1)
                else:
                    of += np.bincount(found, minlength=BUCKETS)
        rows = [(lang, packed(n)) for lang, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "counts"])

    def add(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        total = sum(unpacked(x.as_py(), "<i8") for x in found.column("counts"))
        return pa.table({"lang": [key[0].as_py()], "counts": pa.array([packed(total)], pa.binary())})

    named = docs.where("lang is not null").select(F.lower("lang").alias("lang"), text_bytes().alias("text"))
    found = named.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")
    # One table of fixed size for each language.
    return Model({row["lang"]: unpacked(row["counts"], "<i8") for row in found.collect() if row["lang"] != UNKNOWN})


def _declared(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1))
    return F.when(found != "", found)


def page_evidence(pages: DataFrame, doc: Column) -> DataFrame:
    """doc, text, declared and host of web pages; the text is that of the page's own best containers."""

    @F.pandas_udf("binary")
    def own_text(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda html: Page(html).text(None).encode())

    text = own_text(F.coalesce(F.col("html"), F.lit("")))
    return pages.select(doc.alias("doc"), text.alias("text"), _declared(F.col("html")).alias("declared"), host(F.col("url")).alias("host"))


def document_evidence(docs: DataFrame, doc: Column) -> DataFrame:
    """doc, text, declared and host of documents: their lang is what is declared, their source stands for a host."""
    return docs.select(
        doc.alias("doc"), text_bytes().alias("text"), F.lower("lang").alias("declared"), F.lower(F.coalesce("source", F.lit(""))).alias("host")
    )


def with_likelihoods(evidence: DataFrame, model: Model) -> DataFrame:
    """`evidence` with the mean log likelihoods in place of the text, the number of n-grams, and the likeliest language."""
    shared = evidence.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<means: array<double>, n: long>")
    def likelihoods(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.means(bytes(text)) for text in texts]
        return pd.DataFrame({"means": [x[0] for x in found], "n": [x[1] for x in found]})

    read = evidence.select("doc", "declared", "host", likelihoods("text").alias("read"))
    vote = F.when(F.col("read.n") > 0, F.array_position("read.means", F.array_max("read.means")).cast("int") - 1)
    return read.select("doc", "declared", "host", F.col("read.means").alias("means"), F.col("read.n").alias("n"), vote.alias("vote"))


def _votes(width: int) -> Column:
    return F.array(*(F.sum(F.coalesce((F.col("vote") == i).cast("double"), F.lit(0.0))) for i in range(width)))


def _domain(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*\.?[^.]*)$", 1)


def _suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^.]+)$", 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    total = _total(counts)
    return F.zip_with(counts, prior, lambda n, p: (n + F.lit(weight) * p) / (total + F.lit(weight)))


class Evidence:
    """What is counted over all rows: priors of hosts, likelihoods of declared values and suffixes."""

    def __init__(self, votes: DataFrame, model: Model):
        width = len(model.languages)
        grouped = stored(votes.groupBy("host", "declared").agg(_votes(width).alias("votes")), "votes")

        def summed(key: Column) -> DataFrame:
            total = F.array(*(F.sum(F.col("votes")[i]) for i in range(width)))
            return grouped.groupBy(key.alias("key")).agg(total.alias("votes"))

        overall = (summed(F.lit(0)).collect() or [[0, [0.0] * width]])[0][1]
        known = np.array(overall) + 1.0
        known[-1] = 0.0
        prior = np.append(known[:-1] / max(known.sum(), 1.0) * (1 - _UNKNOWN_PRIOR), _UNKNOWN_PRIOR)
        self.prior = F.array(*(F.lit(float(x)) for x in prior))
        domains = stored(summed(_domain(F.col("host"))).withColumn("domain_prior", _smoothed(F.col("votes"), self.prior, _DOMAIN)), "domains")
        hosts = summed(F.col("host")).select("key", F.col("votes").alias("host_votes"), _domain(F.col("key")).alias("domain"))
        self.hosts = stored(hosts.join(domains.select(F.col("key").alias("domain"), "domain_prior"), "domain").drop("domain"), "hosts")
        self.declared = self._likelihoods(summed(F.col("declared")).where("key is not null"), overall, "declared")
        self.suffixes = self._likelihoods(summed(_suffix(F.col("host"))).where("key <> ''"), overall, "suffixes")

    @staticmethod
    def _likelihoods(pairs: DataFrame, overall: list[float], name: str) -> DataFrame:
        """Log likelihood of each value under each language; unknown languages say nothing about it."""
        pairs = stored(pairs, name)
        values = max(1, pairs.count())
        each = F.array(*(F.lit(float(x)) for x in overall))
        logs = F.zip_with("votes", each, lambda n, total: F.log((n + F.lit(_PAIR)) / (total + F.lit(_PAIR * values))))
        plain = F.transform(logs, lambda x, i: F.when(i == len(overall) - 1, F.log(F.lit(1.0 / values))).otherwise(x))
        return stored(pairs.select("key", plain.alias(f"{name}_log")), name)


def identified(rows: DataFrame, counted: Evidence, model: Model, spread_on: list[str]) -> DataFrame:
    """`rows` of `with_likelihoods` with lang, posterior and accepted."""
    width = len(model.languages)
    keyed = rows.withColumn("suffix", _suffix(F.col("host")))
    for key, side in (("host", counted.hosts), ("declared", counted.declared), ("suffix", counted.suffixes)):
        keyed = lookup_join(keyed, side.withColumnRenamed("key", key), key, "left", spread_on)
    nothing = F.array(*(F.lit(0.0) for _ in range(width)))
    others = F.transform("host_votes", lambda n, i: n - F.coalesce((i == F.col("vote")).cast("double"), F.lit(0.0)))
    prior = F.coalesce(_smoothed(others, F.col("domain_prior"), _HOST), counted.prior)
    n = F.col("n").cast("double")
    text = F.transform("means", lambda mean: mean * n / (1 + n / _WEIGHT))
    scores = F.zip_with(text, prior, lambda a, p: a + F.log(p))
    for name in ("declared", "suffixes"):
        scores = F.zip_with(scores, F.coalesce(F.col(f"{name}_log"), nothing), lambda a, b: a + b)
    scored = keyed.withColumn("scores", scores)
    best = F.array_max("scores")
    names = F.array(*(F.lit(x) for x in model.languages))
    fused = scored.withColumns(
        {
            "lang": F.element_at(names, F.array_position("scores", best).cast("int")),
            "posterior": 1 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - best)),
        }
    )
    accepted = (F.col("n") > 0) & (F.col("lang") != UNKNOWN) & (F.col("posterior") >= 0.5)
    return fused.select(
        "doc",
        "host",
        "declared",
        F.element_at(names, F.col("vote") + 1).alias("text_lang"),
        F.col("n").alias("n_grams"),
        "lang",
        "posterior",
        accepted.alias("accepted"),
    )


def languages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document and page: doc_id, page_id, host, declared, text_lang, n_grams, lang, posterior, accepted.

    A document has no page_id and a page no doc_id. Texts without letters have no text_lang; their lang follows from the
    other evidence, and they are not accepted, nor is what fits no language. A null or missing declaration, address or
    source says nothing; nulls in ids stay null; repeated rows are judged alike; without a document that names its
    language everything is unknown; empty tables give no rows. Further columns are ignored.
    """
    model = train(docs)
    none = F.lit(None).cast("long")
    ids = lambda doc_id, page_id: F.struct(doc_id.alias("doc_id"), page_id.alias("page_id"))
    evidence = document_evidence(docs, ids(F.col("doc_id").cast("long"), none)).unionByName(
        page_evidence(pages, ids(none, F.col("page_id").cast("long")))
    )
    rows = stored(with_likelihoods(evidence, model), "likelihoods")
    found = identified(rows, Evidence(rows, model), model, ["doc"])
    return found.select("doc.doc_id", "doc.page_id", *found.columns[1:])


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, with all their columns.

    The model is learnt from the rows that declare a `lang`; where none does, nothing can be identified and nothing stays. A null or
    empty text is judged by what else is known of it. Null ids and repeated rows are rows like others; an empty table stays empty.
    """
    model = train(docs)
    # Stored with the documents, so that each text is scored once.
    rows = stored(with_likelihoods(document_evidence(docs, F.struct("*")), model), "likelihoods")
    return identified(rows, Evidence(rows, model), model, ["doc"]).where("accepted").select("doc.*")
