import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import HERE, SF, empty_documents, odd_documents

from saleslake.llm import language

PAGES = "page_id long, url string, html string, lang string, host string, doc string, votes string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], PAGES)


def test_ngrams():
    assert language.ngrams(b"").size == language.ngrams(b" 12 .,").size == 0
    assert language.ngrams(b"A.").size == 1
    assert language.ngrams(b"ab, CD").tolist() == language.ngrams(b" ab 7 cd").tolist()
    assert len(language.ngrams("ab cd".encode())) == len(" ab cd ") - 3


def test_odd_rows(spark):
    docs = odd_documents(spark)
    odd = pages(spark, [(1, None, None), (2, "http://a.example.de/", '<html lang="de"><p>'), (None, "x", ""), (3, "http://b.example.fr:80/x", "<p>word word end"), (3, "http://b.example.fr:80/x", "<p>word word end")])
    found = language.languages(docs, odd)
    assert found.columns == ["doc_id", "page_id", "host", "declared", "text_lang", "n_grams", "lang", "posterior", "accepted"]
    rows = found.collect()
    assert len(rows) == docs.count() + 5
    assert all(0 < r["posterior"] <= 1 and (r["n_grams"] > 0 or not r["accepted"]) for r in rows)
    assert {(r["host"], r["declared"], r["n_grams"]) for r in rows if r["page_id"] == 2} == {("a.example.de", "de", 0)}
    third = [tuple(r) for r in rows if r["page_id"] == 3]
    assert len(third) == 2 and third[0] == third[1]
    assert language.languages(empty_documents(spark), pages(spark, [])).collect() == []
    untold = language.languages(empty_documents(spark), odd).collect()
    assert {r["lang"] for r in untold} == {language.UNKNOWN}
    kept = language.drop_unidentified(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert "word " * 30_000 + "end" in texts
    assert None not in texts and "" not in texts


def test_evidence_beyond_the_text(spark):
    """A text that fits two languages alike is told by what its page declares, else by its suffix, else by its host."""
    docs = spark.createDataFrame(
        [(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta", "aa" if i % 2 else "bb", "s") for i in range(60)], "doc_id long, text string, lang string, source string"
    )
    plain = {"aa": "<p>alpha beta gamma</p>", "bb": "<p>delta epsilon zeta</p>"}
    rows = [(i, f"http://h{i % 6}.x{i % 2}.{'ab'[i % 2]}{'ab'[i % 2]}/", f"<html lang={'ab'[i % 2] * 2}>{plain['ab'[i % 2] * 2]}") for i in range(60)]
    neutral = "<p>12 34</p>"
    rows += [(100, "http://new.zz/", f"<html lang=bb>{neutral}"), (101, "http://new.other.aa/", neutral), (102, "http://h1.x1.bb/", neutral), (103, "http://h0.x0.aa/", neutral)]
    found = {r["page_id"]: r for r in language.languages(docs, pages(spark, rows)).where("page_id is not null").collect()}
    assert [found[i]["lang"] for i in (100, 101, 102, 103)] == ["bb", "aa", "bb", "aa"]
    assert not any(found[i]["accepted"] for i in (100, 101, 102, 103))
    assert all(found[i]["lang"] == "ab"[i % 2] * 2 for i in range(60))


def fused(rows, languages, means, counts):
    """Posteriors by dictionaries: rows of (host, declared), their mean likelihoods and numbers of n-grams."""
    width = len(languages)
    vote = [int(np.argmax(m)) if n else None for m, n in zip(means, counts, strict=True)]
    overall = Counter(v for v in vote if v is not None)
    base = np.array([overall[i] + 1.0 for i in range(width - 1)])
    prior = np.append(base / base.sum() * (1 - language._UNKNOWN_PRIOR), language._UNKNOWN_PRIOR)

    def domain(host):
        return ".".join(host.split(".")[-2:])

    def suffix(host):
        return host.rpartition(".")[2] if "." in host else ""

    by = {"host": defaultdict(Counter), "domain": defaultdict(Counter), "declared": defaultdict(Counter), "suffix": defaultdict(Counter)}
    for (host, declared), v in zip(rows, vote, strict=True):
        for kind, key in (("host", host), ("domain", domain(host)), ("declared", declared), ("suffix", suffix(host))):
            by[kind][key].update([] if v is None else [v])
    out = []
    for (host, declared), m, n, v in zip(rows, means, counts, vote, strict=True):
        d, h = by["domain"][domain(host)], by["host"][host]
        smooth = (np.array([d[i] for i in range(width)]) + language._DOMAIN * prior) / (sum(d.values()) + language._DOMAIN)
        own = np.array([h[i] - (i == v) for i in range(width)], float)
        score = np.array(m) * n / (1 + n / language._WEIGHT) + np.log((own + language._HOST * smooth) / (own.sum() + language._HOST))
        for kind, key in (("declared", declared), ("suffix", suffix(host))):
            values = [x for x in by[kind] if x]
            if key:
                score += [math.log(1 / len(values)) if i == width - 1 else math.log((by[kind][key][i] + language._PAIR) / (overall[i] + language._PAIR * len(values))) for i in range(width)]
        best = score.max()
        out.append((languages[int(np.argmax(score))], 1 / np.exp(score - best).sum()))
    return out


@pytest.mark.skipif(not HERE, reason="sample tables are not there")
def test_sample_against_dictionaries(spark):
    docs, web = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    model = language.train(docs)
    counts = {}
    for r in docs.collect():
        found = language.ngrams(r["text"].encode())
        counts.setdefault(r["lang"], np.zeros(language.BUCKETS))
        np.add.at(counts[r["lang"]], found, 1)
    want = language.Model(counts)
    assert want.languages == model.languages
    assert np.allclose(want.logs, model.logs)
    found = language.languages(docs, web).collect()
    texts = {("d", r["doc_id"]): r["text"] for r in docs.collect()} | {("p", r["page_id"]): language.Page(r["html"]).text(None) for r in web.collect()}
    key = lambda r: ("p", r["page_id"]) if r["doc_id"] is None else ("d", r["doc_id"])
    read = [want.means(texts[key(r)].encode()) for r in found]
    expected = fused([(r["host"], r["declared"]) for r in found], want.languages, [m for m, _ in read], [n for _, n in read])
    for r, (lang, posterior) in zip(found, expected, strict=True):
        assert r["lang"] == lang
        assert r["posterior"] == pytest.approx(posterior, rel=1e-6)


@pytest.mark.skipif(not HERE, reason="sample tables are not there")
def test_accuracy(spark):
    docs, web = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/pages.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = language.languages(docs, web).collect()
    named = [r for r in found if r["doc_id"] is not None]
    assert np.mean([r["lang"] == truth[r["doc_id"]] for r in named]) > 0.98
    assert np.mean([r["accepted"] for r in named]) > 0.995
    assert np.mean([r["lang"] == r["declared"] for r in found if r["page_id"] is not None]) > 0.98
