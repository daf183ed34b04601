import zlib

import numpy as np
import pytest
from llm_cases import HERE, SF, empty_documents, odd_documents

from saleslake.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def restorer(spark):
    docs = spark.createDataFrame(
        [(i, "you are a stupid idiot and a pathetic loser, this is worthless trash; the last one was a moron, an ass and a shit") for i in range(50)],
        "doc_id long, text string",
    )
    return toxicity.Restorer(toxicity.character_counts(docs))


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("1d10t", "idiot"), ("$tup1d", "stupid"), ("l0s3r", "loser"), ("m0r0n!!", "moron"), ("stuuuupid", "stupid"), ("tr@sh", "trash"),
        ("p4th3t1c", "pathetic"), ("w0rthl3$$", "worthless"), ("s.t.u.p.i.d", "stupid"), ("st*pid", "stupid"), ("l-o-s-e-r", "loser"),
        ("stuupid", "stupid"), ("looser", "loser"), ("idioot!", "idiot"), ("a$$", "ass"), ("$h!7", "shit"), ("5h17", "shit"),
    ],
)
def test_restored_words(restorer, token, word):
    assert word in restorer.words(token)


def test_spaced_words(restorer):
    assert restorer.spaced("you s t u p i d one") == ["stupid"]
    assert restorer.spaced("such an i-d-i-o-t!") == ["idiot"]
    assert restorer.spaced("a b") == []
    assert restorer.spaced("such a l o s e r") == ["a", "loser"]
    assert restorer.spaced("s t u p i d l o s e r") == ["stupid", "loser"]


@pytest.mark.parametrize(("token", "words"), [("stupid!!", ("stupid",)), ("the***", ("the",)), ("123", ()), ("$100", ()), ("", ()), ("loser", ("loser",))])
def test_plain_words(restorer, token, words):
    assert restorer.words(token) == words


def test_decode_is_the_best_path(restorer):
    """The Viterbi path costs no more than any other reading of a short word."""
    code = restorer.code

    def cost(signs, letters, dropped):
        total, a, b, before = 0.0, 0, 0, ""
        for sign, letter in zip(signs, letters, strict=True):
            if letter is None:
                total += dropped(sign, before)
            else:
                total += (0 if sign in code else toxicity._SIGN) + restorer.cost[a, b, code[letter]]
                a, b = b, code[letter]
            before = sign
        return total + restorer.cost[a, b, 0]

    def dropped(sign, before):
        if sign in code:
            return toxicity._REPEATED if sign == before else float("inf")
        return toxicity._DROPPED

    import itertools

    for signs in ("l0oser", "1diot", "$cum", "trra5h"):
        choices = [[s, None] if s in code else [*toxicity._STANDS_FOR[s], None] for s in signs]
        best = min(itertools.product(*choices), key=lambda letters: cost(signs, letters, dropped))
        assert restorer.decode(signs) == "".join(x or "" for x in best)


def plain_features(word):
    raw = word.encode()
    parts = [b"=" + raw, *(raw[:n] for n in range(3, min(len(raw), 9) + 1))]
    return sorted(zlib.crc32(x) % toxicity.BUCKETS for x in parts)


def test_features_of_words():
    words = ["", "a", "ab", "abc", "idiot", "é", "ébène", "x" * 9, "x" * 10, "worthlessness", "idiot"]
    owner, features = toxicity.features_of(words)
    assert [sorted(features[owner == i].tolist()) for i in range(len(words))] == [plain_features(x) for x in words]
    assert [len(x) for x in toxicity.features_of([])] == [0, 0]


def test_texts_looked_at_together(restorer, monkeypatch):
    """Texts have the features and scores that each has alone, also when tokens are forgotten between."""
    texts = ["", "You 1D10T, idiot!", "l o s e r", "a quiet day", "stuuupid and quiet, s.t.u.p.i.d", "A quiet day"] * 60
    found = toxicity._all_features(restorer, [x.encode() for x in texts])
    for text, features in zip(texts[:6], found, strict=False):
        words = {w for token in set(text.lower().split()) for w in restorer.words(token)} | set(restorer.spaced(text.lower()))
        assert features.tolist() == sorted({x for w in words for x in plain_features(w)})
    chosen = np.unique(np.concatenate([found[1], found[2]]))
    counts = np.zeros(64**3, np.int64)
    alone = [toxicity.Scorer(counts, chosen, np.linspace(0.1, 1, len(chosen)), -2.0).score(x) for x in texts[:6]]
    assert len(set(alone)) > 3
    monkeypatch.setattr(toxicity, "KNOWN_TOKENS", 3)
    scorer = toxicity.Scorer(counts, chosen, np.linspace(0.1, 1, len(chosen)), -2.0)
    groups = list(toxicity._groups([x.encode() for x in texts]))
    assert len(groups) == 2
    assert [x for some in groups for x in scorer.scores(texts[some])] == alone * 60


def test_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, None), (None, 1, 1), (8, None, 0), (99, 1, 1)], LABELS)
    rows = toxicity.scored(docs, labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    found = rows.collect()
    assert len(found) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    fold = {r["doc_id"]: r["held_out"] for r in found}
    assert all(held == (zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2) for i, held in fold.items())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    none = toxicity.scored(docs, spark.createDataFrame([], LABELS)).collect()
    assert len({r["score"] for r in none}) == 1
    assert toxicity.scored(empty_documents(spark), labels).collect() == []


@pytest.mark.skipif(not HERE, reason="sample tables are not there")
def test_held_out_rows(spark):
    """On rows that it was not fitted on, toxic documents are found and clean ones left alone; scores are the model's."""
    sf = f"{SF}/../sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = toxicity.scored(docs, labels).collect()
    held = [(truth[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in truth]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert len(toxic) > 80
    assert np.mean(toxic) > 0.85
    assert np.mean(clean) < 0.02
    scorer = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.limit(200).collect()}
    for r in found:
        if r["doc_id"] in texts:
            assert r["score"] == pytest.approx(scorer.score(texts[r["doc_id"]]))
