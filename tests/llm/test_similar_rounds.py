"""A group in which only a share of the pairs are similar is joined without comparing all."""

from __future__ import annotations

import random

import pyarrow as pa

from loam.llm import jaccard, simhash


def test_a_group_of_near_copies_is_joined_without_all_its_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
    texts = []
    for k in range(160):
        words = list(base)
        for at in rnd.sample(range(100), 1 + (k % 4 == 0)):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    sets = [set(jaccard.shingle_hashes(pa.array([t]), 5)[0].tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    sizes, inner = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets: sizes.append(pairs.count()) or inner(pairs, sets))
    monkeypatch.setattr(jaccard, "HEADS", 1)
    monkeypatch.setattr(jaccard, "MEMBERS", 8, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # An index that links nothing leaves all to shared shingles.
    none = lambda nodes: simhash.fingerprint_links(nodes).limit(0)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(docs, none).collect()}
    assert found == dict(enumerate(root))
    assert sum(sizes) < 160 * 159 // 2 // 2, sizes


def test_sets_of_a_frequent_shingle_are_compared_in_parts_and_at_last_all(spark):
    scratch = jaccard.Scratch(spark, "rounds")
    places = spark.range(200).selectExpr("id AS node", "100 AS n", "0 AS p", "7L AS shingle")
    links = spark.createDataFrame([(1, 0)], "a long, b long")
    few, every = (jaccard._across(jaccard._mixed(scratch, places, links, most, turn)).count() for turn, most in enumerate((8, 200)))
    assert every == 200 * 199 // 2 - 1
    assert 0 < few < every / 16
