"""The first hidden Markov model comes from all training documents."""

from collections import Counter

from pyspark.sql import functions as F

from loam.llm import hmm


def test_words_of_any_document_are_in_the_first_model(spark):
    ids = [r["id"] for r in spark.range(2_500).orderBy(F.xxhash64("id")).collect()]
    late = set(ids[-400:])
    docs = spark.createDataFrame([(k, "late one here" if k in late else "some other words") for k in ids], "doc_id long, text string")
    _, vocabulary, model = hmm.fit(docs, states=3, rounds=0)
    assert model.emit[vocabulary.rows["late"]].max() >= 0.9 * 400 / vocabulary.tokens
    assert abs(model.emit.sum(0) - 1).max() < 1e-6 and abs(model.move.sum(1) - 1).max() < 1e-6


def test_neighbours_are_counted_in_all_texts(spark):
    texts = ["A b  a", None, "", "b\tc b", "c a a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    expected = Counter()
    for t in texts:
        seen = [{"a": 1, "b": 2}.get(w, 3) for w in (t or "").lower().split()] + [0]
        expected.update(zip([4, *seen], seen))
    table = hmm.count_pairs(docs.repartition(3), ["a", "b"])
    assert {(i, j): int(n) for i, row in enumerate(table) for j, n in enumerate(row) if n} == dict(expected)
