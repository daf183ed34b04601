import random

import numpy as np
import pytest
import xxhash
from llm_cases import HERE, SF, empty_documents, odd_documents

from saleslake.llm import simhash
from saleslake.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_shingles(text, width):
    found = (text or "").translate(LOWER).encode().split()
    if len(found) < width:
        return [b" ".join(found)] if found else []
    return [b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)]


def plain_fingerprint(text, width=4):
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in plain_shingles(text, width)]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def reachable(nodes, linked):
    """Smallest node reachable from each, by flooding."""
    found = {}
    for start in sorted(nodes):
        if start in found:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in found:
                found[x] = start
                todo += [y for y in nodes if y not in found and linked(x, y)]
    return found


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = {}
    for r in rows:
        prints.setdefault(plain_fingerprint(r["text"]), []).append(r["doc_id"])
    near = reachable(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for fp, root in near.items():
        ids = [x for x in prints[fp] if x is not None]
        if ids:
            smallest[root] = min(smallest.get(root, 10**9), *ids)
    want = sorted(((r["doc_id"], f"{plain_fingerprint(r['text']):016x}", smallest.get(near[plain_fingerprint(r["text"])])) for r in rows), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == want
    assert simhash.near_duplicates(empty_documents(spark)).collect() == []


@pytest.mark.parametrize("at_once", [200, 1_000_000])
def test_links_connect_all_that_are_near(at_once):
    """Chains and clumps of fingerprints: the links of all buckets give the components of all pairs, in small steps too."""
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for centre in prints[:6]:
        for _ in range(12):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints = list(dict.fromkeys(prints))
    fps, ids = np.array(prints, np.uint64), np.arange(len(prints))
    label = {i: i for i in range(len(prints))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for bucket in range(1 << 6):
        flips = np.bitwise_count((fps >> np.uint64(58)) ^ np.uint64(bucket))
        there = flips <= 2
        for u, v in zip(*simhash.bucket_links(fps[there], ids[there], bucket, 4, 6, at_once=at_once), strict=True):
            a, b = sorted((root(int(u)), root(int(v))))
            label[b] = a
    want = reachable(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: root(i) for i in label} == want


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    pairs += [(None, 5), (7, 7)]
    found = dict(map(tuple, connected(spark.createDataFrame(pairs, "u long, v long")).collect()))
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    sides = {}
    for a, b in real:
        sides.setdefault(a, set()).add(b)
        sides.setdefault(b, set()).add(a)
    assert found == reachable(list(sides), lambda a, b: b in sides[a])
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.skipif(not HERE, reason="sample tables are not there")
def test_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    want = reachable(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def grouped_by_text(rows):
    """The rows (doc_id, text) that stay: of each group of fingerprints the smallest id; repeated rows are one document."""
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(plain_fingerprint(text), set()).add((doc_id is None, doc_id or 0, doc_id, text))
    near = reachable(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = {}
    for fp, root in near.items():
        groups.setdefault(root, set()).update(prints[fp])
    return groups.values()


def check_kept(docs):
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()]
    groups = grouped_by_text([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(kept) == len(groups)
    for members in groups:
        first = min(m[:2] for m in members)
        assert sum((m[2], m[3]) in kept for m in members if m[:2] == first) == 1
    return kept


def test_drop_keeps_one_of_each_group(spark):
    """Copies with some words changed, chains of them, exact copies and documents of their own."""
    rng = random.Random(11)
    lexicon = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = []
    for _ in range(30):
        words = [rng.choice(lexicon) for _ in range(rng.randint(200, 800))]
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = rng.choice(lexicon)
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, doc string")
    assert 30 <= len(check_kept(docs)) < len(texts)


def test_drop_keeps_columns_and_takes_odd_documents(spark):
    docs = odd_documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    check_kept(docs)
    assert simhash.drop_near_duplicates(empty_documents(spark)).collect() == []


def test_texts_that_share_an_id(spark):
    """A near copy goes, but not another text with its id; repeated rows are one document."""
    text = " ".join(f"w{i}" for i in range(2000))
    other = " ".join(f"v{i}" for i in range(200))
    assert (plain_fingerprint(text) ^ plain_fingerprint(text + " end")).bit_count() <= 4
    rows = [(1, text), (2, text + " end"), (2, other), (2, other), (1, "w"), (1, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.drop_near_duplicates(docs).collect())) == sorted([(1, text), (2, other), (1, "w"), (1, "v")])
