import os
import sys

import pytest
from llm_cases import HERE, SF, empty_documents, odd_documents
from test_simhash import plain_fingerprint, reachable

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from saleslake.llm import language  # noqa: E402

PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.skipif(not HERE, reason="sample tables are not there")
def test_each_stage_against_brute_force(spark):
    sf = f"{SF}/../sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        rows = docs.collect()
        assert all(text[r["doc_id"]] == r["text"] for r in rows)
        kept[name] = {r["doc_id"] for r in rows}
        assert len(rows) == len(kept[name])

    everything = set(text)
    named = language.languages(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet").limit(0))
    assert kept["language ID"] == {r["doc_id"] for r in named.where("accepted").collect()}
    assert len(kept["language ID"]) > 0.99 * len(everything)

    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i in kept["language ID"] if truth.get(i) == 0]
    assert sum(i in kept["toxicity"] for i in clean) > 0.97 * len(clean)
    toxic = [i for i in kept["language ID"] if truth.get(i) == 1]
    assert sum(i in kept["toxicity"] for i in toxic) < 0.4 * len(toxic)

    best = {}
    for i in kept["toxicity"]:
        bare = "".join(text[i].translate({ord(x): None for x in " \t\n\x0b\x0c\r"}))
        best[bare] = min(best.get(bare, (0, 0)), (-len(text[i]), i)) if bare in best else (-len(text[i]), i)
    assert kept["exact dedup"] == {i for _, i in best.values()}

    left = sorted(kept["exact dedup"])
    prints = {i: plain_fingerprint(text[i]) for i in left}
    near = reachable(left, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert kept["SimHash near-dedup"] == set(near.values())
    assert len(kept["SimHash near-dedup"]) < len(left)

    packed = corpus_pipeline.run(spark, sf)
    assert packed.columns == PIECE
    assert {r["doc_id"] for r in packed.collect()} == kept["SimHash near-dedup"]


@pytest.mark.skipif(not HERE, reason="sample tables are not there")
def test_odd_and_empty_documents(spark):
    for start in (odd_documents(spark), empty_documents(spark)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == PIECE
        docs.collect()
