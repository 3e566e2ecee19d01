"""Words nearly spelled, expansion rules, names in questions, and their stages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loam.functions import lexical
from loam.operators import expansion, names, rescue
from loam.plans.names import _letters, merged


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_near_words_are_all_words_within_the_edits(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc1") for _ in range(rnd.randrange(1, 12)))
    known = sorted({word() for _ in range(400)} | {"abcabcabcabcabc" + "c" * k for k in range(4)} | {"a" * 3_000, "a" * 3_001})
    asked = sorted({word() for _ in range(40)} | {"abcabcabcabcabc", "b" + "a" * 2_999, "ab"})
    found = lexical.near_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w, 1) for w in known], "term string, df int"))
    allowed = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    short = [w for w in known if len(w) < 100]
    wanted = {(w, t, edits(w, t)) for w in asked if len(w) < 100 for t in short if edits(w, t) <= allowed(w)} | {("b" + "a" * 2_999, "a" * 3_000, 1), ("b" + "a" * 2_999, "a" * 3_001, 2)}
    assert sorted((r["word"], r["term"], r["edits"]) for r in found.collect()) == sorted(wanted)


def test_fielded_search_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WORDS_AT_ONCE", 2)
    rows = [(1, "red apple pie", "fruit"), (2, "green aple", None), (3, None, "apple"), (4, "", ""), (None, "apple", "apple"), (5, "banana banana banana", "fruit")]
    docs = spark.createDataFrame(rows, "id long, body string, tag string")
    asked = spark.createDataFrame([(1, "Apple!"), (2, "bananna"), (3, ""), (4, None), (5, "zzzzzz"), (6, "fruit")], "q long, text string")
    found = lexical.lexical_search(docs, "id", {"body": (F.col("body"), 3.0), "tag": (F.col("tag"), 1.0)}, asked, "q", "text", 10).collect()
    hits = {(r["item_id"], r["doc_id"]): r["score"] for r in found}
    assert set(hits) == {(1, 1), (1, 2), (1, 3), (2, 5), (6, 1), (6, 5)} and hits[1, 1] == hits[2, 5] == 1.0
    assert lexical.lexical_search(docs.limit(0), "id", {"body": (F.col("body"), 1.0)}, asked, "q", "text", 3).count() == 0
    assert lexical.lexical_search(docs, "id", {"body": (F.col("body"), 1.0)}, asked.limit(0), "q", "text", 3).count() == 0


def test_rescue_terms_and_rows(spark):
    asked = spark.createDataFrame([(1, "What about THE Coffee, coffee and a roast? tell me"), (2, None), (3, "a b c")], "query_id long, text string")
    terms = asked.select("query_id", rescue.rescue_terms(F.col("text")).alias("terms"))
    assert {r["query_id"]: r["terms"] for r in terms.collect()} == {1: ["coffee", "roast"], 2: None, 3: []}
    docs = spark.createDataFrame([(10, "my COFFEEpot", 0.1), (11, None, 0.2), (12, "roasted coffee", 0.3)], "id long, text string, importance double")
    assert sorted(map(tuple, rescue.rows_with_terms(docs, terms).collect())) == [(1, 10, 0.1), (1, 12, 0.3)]
    hits = spark.createDataFrame([(1, 10, 0.4), (1, 99, 1.3), (1, 98, 0.2)], "query_id long, id long, score double")
    lifted = spark.createDataFrame([(1, 10), (1, 99), (1, 12)], "query_id long, id long")
    assert {r["id"]: (r["score"], r["rescued"]) for r in rescue.inject(hits, [(lifted, 1.1)]).collect()} == {10: (1.1, True), 99: (1.3, True), 98: (0.2, False), 12: (1.1, True)}


FAMILIES = [
    ("What does Zed like?", ["Zed preferences", "Zed favorites"]),
    ("Tell me about  gold ", ["gold details", "gold information"]),
    ("how can I bake", ["bake guide", "bake steps"]),
    ("when was y2k", ["y2k date", "y2k time"]),
    ("Why is sky", ["sky reason", "sky cause"]),
    ("where are keys", ["keys location", "keys place"]),
    ("what happened to Al", ["Al events", "Al incident"]),
    ("remember when x", ["x", "x memory"]),
    ("git best practices", ["git guidelines", "git recommendations"]),
    ("issues with db", ["db bugs", "db errors"]),
    ("what do I know about ants??", ["ants", "ants details"]),
    ("what have I learned", ["lessons learned", "insights"]),
    ("who is Bo?", ["Bo", "about Bo"]),
    ("what is art", ["art", "art definition"]),
    ("code now", ["program now", "software now"]),
    ("health", ["health fitness", "health wellness"]),
    ("oh my", ["oh user"]),
    ("plum", []),
    (None, []),
]


def test_each_family_of_rules(spark):
    df = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(FAMILIES)], "item_id long, text string")
    found: dict[int, list] = {}
    for r in expansion.expand_queries(df).orderBy("item_id", "position").collect():
        found.setdefault(r["item_id"], []).append((r["variant"], r["source"]))
    for k, (question, first) in enumerate(FAMILIES):
        assert found[k][0] == (question or "", "original")
        assert [v for v, _ in found[k][1 : 1 + len(first)]] == first and len(found[k]) <= 7
    assert len(found[17]) == len(found[18]) == 1
    fewer = expansion.expand_queries(df, expansion.FEWER_VARIANTS).groupBy("item_id").count().agg(F.max("count")).first()[0]
    assert fewer == 3
    same = expansion.expand_queries(spark.createDataFrame([(1, "big big code")], "item_id long, text string"), synonyms={"big": ["large"], "code": ["big"]}, related={"x": ["y"]}, persons={"zz": "q"})
    assert [r["variant"] for r in same.orderBy("position").collect()] == ["big big code", "large large code", "big big big"]


def test_names_that_a_question_spots(spark):
    rows = [
        ("Where did Alice Smith, and 'Old Mill' go? Bob left. My dog barks at THE Cat", ["Old Mill", "Alice", "Smith", "dog", "Cat"]),
        ('"a" "b" "c" "d" "e" "f"', list("abcde")),
        ("our", []), ("I saw The man and our it", []), ("", []), (None, []), ("see his car, her car.", ["car"]),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, text string")
    found = {r["k"]: r["n"] for r in df.select("k", names.spotted_names(F.col("text")).alias("n")).collect()}
    assert found == {k: n for k, (_, n) in enumerate(rows)}


def test_a_resolved_name_is_seen_by_no_later_stage(spark):
    entities = spark.createDataFrame([(1, "river bank"), (2, "river bank"), (3, "rivers banks"), (4, "knab"), (5, "stone")], "entity long, name string")
    aliases = spark.createDataFrame([(3, "River Bank"), (5, "pebble"), (4, "pebble")], "entity long, alias string")
    asked = spark.createDataFrame([(1, "RIVER bank"), (2, "Pebble"), (3, "rivers bank"), (4, "riverbank"), (5, "bnak"), (6, "qq"), (7, None)], "ask long, name string")
    found = {r["ask"]: (r["entity"], r["stage"]) for r in names.resolve_names(asked, entities, aliases, _letters).collect()}
    assert found == {1: (1, "exact"), 2: (4, "alias"), 3: (3, "fuzzy"), 4: (1, "fuzzy"), 5: (4, "vector"), 6: (None, "none"), 7: (None, "none")}
    assert {r["stage"] for r in names.resolve_names(asked.where("ask = 5"), entities, aliases, None).collect()} == {"none"}


@pytest.mark.parametrize("over", [0.2, 0.4, 0.7])
def test_best_by_grams_is_the_best_of_all(spark, over):
    rnd = random.Random(int(over * 10))
    name = lambda: " ".join("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 4)))
    entities, asked = [(k, name()) for k in range(150)], [(k, name()) for k in range(40)]
    grams = lambda s: {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}
    wanted = {}
    for a, s in asked:
        scores = [(-round(len(grams(s) & grams(t)) / len(grams(s) | grams(t)), 6), e) for e, t in entities]
        if min(scores)[0] < -over:
            wanted[a] = min(scores)[1]
    found = names.best_by_grams(spark.createDataFrame(asked, "ask long, name string"), spark.createDataFrame(entities, "entity long, name string"), over)
    assert {r["ask"]: r["entity"] for r in found.collect()} == wanted


def test_recall_through_the_graph_and_its_merge(spark):
    entities = spark.createDataFrame([(1, "Ann"), (2, "Mill"), (3, "Old Mill House"), (4, "Far")], "entity long, name string")
    aliases = spark.createDataFrame([(2, "Works")], "entity long, alias string")
    edges = spark.createDataFrame([(1, 2), (2, 4), (4, 1)], "src long, dst long")
    mentions = spark.createDataFrame([(1, 100), (1, 100), (2, 100), (2, 200), (3, 300), (4, 400)], "entity long, id long")
    asked = spark.createDataFrame([(7, "Is Ann at 'Works'?"), (8, "nobody"), (9, None)], "query_id long, text string")
    found = names.graph_recall(asked, entities, aliases, edges, mentions, 10)
    # Ann: 100; around her the mill 100, 200 and Far 400.  The mill: 100, 200; around it Far 400 and Ann 100.
    assert {(r["query_id"], r["id"]): (r["hits"], r["score"]) for r in found.collect()} == {(7, 100): (4, 1.0), (7, 200): (2, 0.8), (7, 400): (2, 0.8)}
    hits = spark.createDataFrame([(7, 100, 0.5), (7, 1, 0.4)], "query_id long, id long, score double")
    assert {r["id"]: round(r["score"], 6) for r in merged(hits, found).collect()} == {100: 0.6, 1: 0.4, 200: 0.8, 400: 0.8}


def test_quoted_names_keep_the_digits_at_their_ends(spark):
    text = F.lit('What of "blue ring Brand#10", "1 red bolt Brand#21" and "2 big nuts 22"?')
    assert spark.range(1).select(names.spotted_names(text).alias("n")).first()["n"] == ["blue ring Brand#10", "1 red bolt Brand#21", "2 big nuts 22"]


def test_names_of_entities_are_not_broadcast(spark, monkeypatch):
    built = []
    inner = names.checkpointed
    monkeypatch.setattr(names, "checkpointed", lambda df: built.append(df._jdf.queryExecution().executedPlan().toString()) or inner(df))
    entities = spark.createDataFrame([(1, "blue ring"), (2, "red bolt")], "entity long, name string")
    asked = spark.createDataFrame([(7, "BLUE RING"), (8, "red bol")], "ask long, name string")
    found = names.resolve_names(asked, entities, spark.createDataFrame([], "entity long, alias string"), None)
    assert {(r["ask"], r["entity"], r["stage"]) for r in found.collect()} == {(7, 1, "exact"), (8, 2, "fuzzy")}
    assert "SortMergeJoin" in built[0] and "BroadcastHashJoin" not in built[0]
