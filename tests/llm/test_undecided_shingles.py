"""Rounds look again only at shingles whose sets are in several components still."""

from __future__ import annotations

import random

from loam.llm import jaccard, simhash


def _joined(pairs, root):
    for a, b in pairs:
        x, y = sorted((root.setdefault(a, a), root.setdefault(b, b)))
        root.update({k: x for k, r in root.items() if r == y})
    return root


def test_later_rounds_take_only_shingles_that_are_undecided(spark, monkeypatch):
    rnd = random.Random(5)
    texts = []
    for group in range(2):
        base = [f"w{group}-{k}" for k in range(60)]
        for k in range(8):
            words = list(base)
            words[rnd.randrange(60)] = f"x{group}-{k}"
            texts.append(" ".join(words))
    # Alike in too few words: their shingles stay undecided to the last round.
    texts += [" ".join([f"h{k}" for k in range(20)] + [f"t{k}-{j}" for j in range(8)]) for k in range(12)]
    taken, inner = [], jaccard._mixed

    def mixed(scratch, places, *more):
        taken.append(places.count())
        return inner(scratch, places, *more)

    def components(edges, a, b):  # in the driver: many small jobs less
        return spark.createDataFrame(list(_joined([(r[a], r[b]) for r in edges.collect()], {}).items()), "node long, component long")

    monkeypatch.setattr(jaccard, "_mixed", mixed)
    monkeypatch.setattr(jaccard, "connected_components", components)
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    none = lambda nodes: simhash.fingerprint_links(nodes).limit(0)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(docs, none).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert found == _joined(alike, {k: k for k in range(len(texts))})
    assert len(taken) > 1 and max(taken[1:]) < taken[0], taken
