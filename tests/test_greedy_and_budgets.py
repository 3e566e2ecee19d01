"""Order-dependent operators and similarity joins against plain loops."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loam.functions.lexical import tfidf_top
from loam.functions.vectors import block_join, block_search
from loam.operators import budget, dedup, greedy
from loam.plans import context, recall, texts

rng = np.random.default_rng(3)
VECTORS = [(k, int(k % 3), (rng.standard_normal(4) + np.eye(4)[k % 4] * 2).tolist()) for k in range(90)]


def cosines():
    v = np.array([x for _, _, x in VECTORS])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T


def vectors(spark):
    return spark.createDataFrame(VECTORS, "id long, label int, embedding array<double>")


def test_drop_losers_in_order(spark):
    pairs = [(a, b, round(random.Random(a * 97 + b).random(), 2)) for a in range(60) for b in range(a + 1, 60) if (a * b + a) % 7 == 0]
    gone = set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in gone and b not in gone:
            gone.add(b)
    df = spark.createDataFrame(pairs, "id1 long, id2 long, score double")
    assert sorted(r["id"] for r in greedy.drop_losers(df).collect()) == sorted(gone)
    assert greedy.drop_losers(df.limit(0)).count() == 0
    own = {k: random.Random(k).randrange(5) for k in range(60)}
    gone = set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in gone and b not in gone:
            gone.add(b if own[a] >= own[b] else a)
    scored = spark.createDataFrame([(a, b, s, own[a], own[b]) for a, b, s in pairs], "id1 long, id2 long, score double, score1 int, score2 int")
    assert sorted(r["id"] for r in greedy.drop_losers(scored).collect()) == sorted(gone)


@pytest.mark.parametrize("size", [1, 3, 6])
def test_seed_clusters_in_order(spark, size):
    s, out = cosines(), []
    for label in range(3):
        free = {k for k, x, _ in VECTORS if x == label}
        for k in sorted(free):
            near = {j for j in free if s[k, j] >= 0.7 or j == k} if k in free else set()
            if len(near) >= size:
                out += [(label, k, j) for j in near]
                free -= near
    found = greedy.seed_clusters(vectors(spark), "label", 0.7, size).collect()
    assert sorted((r["label"], r["seed"], r["id"]) for r in found) == sorted(out)


def test_a_chain_of_many_rounds(spark):
    pairs = spark.createDataFrame([(k, k + 1, 1.0 - k / 100) for k in range(20)], "id1 long, id2 long, score double")
    assert sorted(r["id"] for r in greedy.drop_losers(pairs).collect()) == list(range(1, 21, 2))


def test_a_vector_of_another_size_changes_nothing_else(spark):
    rows = vectors(spark)
    odd = rows.unionByName(spark.createDataFrame([(1_000, 0, [1.0]), (1_001, 0, [-2.0]), (1_002, 0, [3.0]), (1_003, 1, None), (1_004, 1, [float("nan")])], rows.schema))
    for key in (None, "label"):
        before, after = (sorted(map(tuple, block_join(df, "id", "embedding", 0.8, key).collect())) for df in (rows, odd))
        assert after == sorted([*before, (1_000, 1_002, 1.0)])
    before, after = (sorted(map(tuple, block_search(df.where("id % 30 = 0 OR id = 1000"), df, "id", "embedding", k=2).collect())) for df in (rows, odd))
    assert [r for r in after if r[0] < 1_000] == before and [r[1:] for r in after if r[0] == 1_000] == [(1_000, 1.0), (1_002, 1.0)]


def test_cells_give_the_pairs_of_blocks_and_copy_less(spark, monkeypatch):
    import numpy as np

    from loam.functions import vectors as v

    monkeypatch.setattr(v, "BLOCK_ROWS", 40)
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(25, 16))
    rows = [(k, (centres[k % 25] + 0.15 * rnd.normal(size=16)).tolist()) for k in range(1_000)] + [(2_000 + k, [1.0, float(k)]) for k in range(5)] + [(3_000, [0.0] * 16), (3_001, None)]
    rows += [(4_000 + k, centres[3].tolist()) for k in range(90)]  # a crowded cell
    df = spark.createDataFrame(rows, "id long, v array<double>")
    pairs = lambda found: {(r["id1"], r["id2"]): round(r["score"], 9) for r in found.collect()}
    for least in (0.3, 0.9, 0.999):
        joined = v.cell_join(df, "id", "v", least)
        found = joined.collect()
        assert len(found) == len({(r["id1"], r["id2"]) for r in found})
        assert pairs(joined) == pairs(v.block_join(df, "id", "v", least))
    assert pairs(v.cell_join(df, "id", "v", 0.9, most_cells=1)) == pairs(v.block_join(df, "id", "v", 0.9))
    assert v.cell_join(df.limit(0), "id", "v", 0.9).count() == 0
    unit, pivots = v._unit(np.array([x for _, x in rows[:1_000]])), {16: (list(range(25)), v._unit(centres))}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(unit.tolist())], names=["id", "v"])
    visits = sum(b.num_rows for b in v._reached(pivots, dict.fromkeys(range(25), 0.4), 0.95)([batch]))
    assert visits < 1_000 * 6  # of 25 cells


def test_vectors_per_group_and_per_key(spark):
    s = cosines()
    wanted = {(q, x, j) for q in range(0, 90, 30) for x in range(3) for j in sorted((k for k, y, _ in VECTORS if y == x), key=lambda k: (-round(s[q, k], 9), k))[:2]}
    found = block_search(vectors(spark).where("id % 30 = 0"), vectors(spark).repartition(3), "id", "embedding", k=2, group="label")
    assert {(r["query_id"], r["label"], r["id"]) for r in found.collect()} == wanted
    joined = {(r["id1"], r["id2"]) for r in block_join(vectors(spark), "id", "embedding", 0.8, "label").collect()}
    assert joined == {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 3 == b % 3 and s[a, b] >= 0.8}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


NAMES = ["", "a", "ab", "anna", "anna smith", "anna smyth", "ana smith", "bob stone", "bob stones", "rob stone", "aaaaaaaaaa", "aaaaaaaaab", "xaaaaaaaaa", "Ünal Öz", "Ünal Oz"]


@pytest.mark.parametrize("least", [0.7, 0.8, 0.9, 1.0])
def test_close_texts_misses_no_pair(spark, least):
    rows = [(k, t, k % 2) for k, t in enumerate(NAMES * 2)] + [(99, None, 0)]
    similar = lambda a, b: 1.0 if not max(len(a), len(b)) else 1 - edits(a, b) / max(len(a), len(b))
    wanted = {(i, j) for i, a, x in rows[:-1] for j, b, y in rows[:-1] if i < j and x == y and similar(a, b) >= least}
    found = dedup.close_texts(spark.createDataFrame(rows, "id long, t string, b int"), "id", "t", least, F.col("b")).collect()
    assert {(r["id1"], r["id2"]) for r in found} == wanted and len(found) == len(wanted)
    with pytest.raises(ValueError, match="shared gram"):
        dedup.close_texts(spark.createDataFrame(rows, "id long, t string, b int"), "id", "t", 0.5, F.col("b"))


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_similar_sets_miss_no_pair(spark, least):
    r = random.Random(4)
    rows = [(k, k % 2, r.sample("abcdefghij", r.randrange(1, 8))) for k in range(60)]
    wanted = {(a, b) for a, x, s in rows for b, y, t in rows if a < b and x == y and len(set(s) & set(t)) / len(set(s) | set(t)) >= least}
    found = dedup.similar_sets(spark.createDataFrame(rows, "id long, k int, x array<string>"), least).collect()
    assert {(x["id1"], x["id2"]) for x in found} == wanted


def test_tfidf_ties_and_empty_texts(spark):
    docs = spark.createDataFrame([(3, "red fox"), (1, "Red fox!"), (2, None), (4, ""), (5, "dog")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a red fox"), (8, None), (9, "cat")], "item_id long, text string")
    found = tfidf_top(docs, "doc_id", "text", asked, "item_id", "text", 1).collect()
    assert [(r["item_id"], r["doc_id"]) for r in found] == [(7, 1)]
    assert tfidf_top(docs.limit(0), "doc_id", "text", asked, "item_id", "text", 1).count() == 0


def row(position, tokens, critical=False, constraint=False, score=0.0, boost=0.0):
    return {"position": position, "tokens": tokens, "critical": critical, "constraint": constraint, "score": score, "boost": boost}


def test_layer_selection_phases():
    rows = [row(0, 50), row(1, 30, constraint=True), row(2, 500, critical=True), row(3, 15, constraint=True), row(4, 10)]
    assert budget.layer_selection(rows, 100, 40) == {1, 2}
    assert budget.layer_selection(rows[:2] + rows[3:], 100, 40) == {1, 0, 3}
    assert budget.layer_selection(rows[:2] + rows[3:], 60, 0) == {1, 3, 4}


def test_scoped_selection_phases():
    rows = [row(0, 40, score=0.9), row(1, 20, constraint=True, score=0.1), row(2, 45, score=0.5), row(3, 8, score=0.4), row(4, 25, score=0.2, boost=0.5), row(5, 900, critical=True)]
    assert budget.scoped_selection(rows, 100) == {5: "critical", 0: "task", 3: "task", 4: "background"}
    assert budget.scoped_selection(rows[:5], 100) == {1: "critical", 0: "task", 3: "task", 4: "background"}


def test_contexts_against_plain_loops(spark, sf_dir):
    turns = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    layer = turns.role.map({"system": "IDENTITY", "user": "PROJECT"}).fillna("SESSION")
    wanted = {}
    for key, rows in turns.assign(layer=layer).sort_values("turn").groupby(["conv_id", "layer"]):
        cap = int(400 * {"IDENTITY": 0.44, "PROJECT": 0.33, "SESSION": 0.22}[key[1]])
        reserve, used, own, kept = (min(200, cap // 4) if key[1] == "IDENTITY" else 0), 0, 0, []
        facts = [(t, -(-len(x) // 4), bool(re.search(r"(?i)\b(password|secret|token)\b", x)), bool(re.search(r"(?i)\b(must|never|always|that)\b", x))) for t, x in zip(rows.turn, rows.text, strict=True)]
        for t, n, critical, _ in facts:
            if critical:
                kept.append(t)
                used += n
        for t, n, critical, rule in facts:
            if rule and not critical:
                fits = not reserve or own + n <= reserve
                if fits or used + n <= cap:
                    own += n if fits else 0
                    kept.append(t)
                    used += n
        for t, n, *_ in facts:
            if t not in kept and used + n <= cap:
                kept.append(t)
                used += n
        wanted |= {(key[0], t): "kept" if t in kept else "evicted" for t, *_ in facts}
    assert {(r["conv_id"], r["turn"]): r["state"] for r in context.layer_context(spark, sf_dir).collect()} == wanted
    sections = context.scoped_context(spark, sf_dir).groupBy("conv_id", "section").agg(F.sum("tokens").alias("n")).collect()
    assert all(r["n"] <= {"task": 200, "background": 120}.get(r["section"], 10**9) for r in sections) and {r["section"] for r in sections} >= {"task"}


def test_recall_pipeline_ranks_and_floor(spark, sf_dir):
    rows = recall.recall_pipeline(spark, sf_dir).toPandas()
    for _, own in rows.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and own.score.is_monotonic_decreasing and own.score.min() >= 0.7 * own.score.max() - 1e-6


def test_context_budget_and_segments_against_plain_loops(spark, sf_dir):
    turns = pd.read_parquet(f"{sf_dir}/conversations.parquet").sort_values(["conv_id", "turn"])
    wanted = set()
    for conv, rows in turns.groupby("conv_id"):
        left = 400
        for t, x in zip(rows.turn, rows.text, strict=True):
            if -(-len(x) // 4) <= left:
                left -= -(-len(x) // 4)
                wanted.add((conv, t))
    assert {(r["conv_id"], r["turn"]) for r in texts.context_budget(spark, sf_dir).collect()} == wanted
    docs = dict(pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "text"]].itertuples(index=False))
    for r in texts.segment_text(spark, sf_dir).collect():
        assert " ".join(docs[r["id"]][r["start"] :].split()).startswith(" ".join(r["segment"].split())[:40])
