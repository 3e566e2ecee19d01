"""The vector store against a dictionary, over versions, repeated batches and failures."""

from __future__ import annotations

import random

import pytest

from loam.sources.vectors import SCHEMA, VectorStore


def held(df):
    rows = df.collect()
    found = {(r["id"], r["model"]): (r["vector"], r["updated"]) for r in rows}
    assert len(found) == len(rows)
    return found


def put(state, rows):
    for i, model, vector, updated in rows:
        if updated >= state.get((i, model), (None, -1))[1]:
            state[i, model] = (vector, updated)
    return dict(state)


def batch(seed, n=60):
    rnd = random.Random(seed)
    keys = {(rnd.randrange(80), rnd.choice(["a", "b"])) for _ in range(n)}
    return [(i, m, [rnd.randrange(8) / 8, 1.0], rnd.randrange(5)) for i, m in sorted(keys)]


def test_upserts_and_versions(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/store", 8)
    assert store.read().count() == 0 and store.versions() == []
    state, seen = {}, []
    for k in range(4):
        rows = batch(k)
        assert store.upsert(spark.createDataFrame(rows, SCHEMA), "s", k) == k + 1
        seen.append(put(state, rows))
        assert held(store.read()) == seen[-1]
    assert store.upsert(spark.createDataFrame(batch(9), SCHEMA), "s", 3) == 4 and held(store.read()) == seen[-1]
    assert [held(store.read(v)) for v in store.versions()] == seen
    before = store.manifest()["buckets"]
    store.upsert(spark.createDataFrame([(1, "a", [0.5], 99)], SCHEMA))
    after = store.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and held(store.read())[1, "a"] == ([0.5], 99)
    assert VectorStore(spark, store.root, 3).manifest()["count"] == 8


@pytest.mark.parametrize("row", [(None, "a", [1.0], 1), (1, None, [1.0], 1), (1, "a", None, 1), (1, "a", [], 1), (1, "a", [float("nan")], 1), (1, "a", [float("inf")], 1)])
def test_bad_rows_write_nothing(spark, tmp_path, row):
    store = VectorStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match="no key"):
        store.upsert(spark.createDataFrame([(2, "a", [1.0], 1), row], SCHEMA))
    assert store.versions() == [] and store.read().count() == 0


def test_two_writers_of_one_version(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/store")
    store.upsert(spark.createDataFrame([(1, "a", [1.0], 1)], SCHEMA))
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(store.manifest())
    assert held(store.read()) == {(1, "a"): ([1.0], 1)}


def test_a_stream_whose_batches_come_again(spark, tmp_path):
    store, state = VectorStore(spark, f"file://{tmp_path}/store", 4), {}
    for k in range(3):
        spark.createDataFrame(batch(k), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        put(state, batch(k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store.follow(stream, "in", f"{tmp_path}/first").awaitTermination()
    assert len(store.versions()) == 3
    store.follow(stream, "in", f"{tmp_path}/second").awaitTermination()  # a lost checkpoint: all batches come again
    assert len(store.versions()) == 3
    found = held(store.read())
    assert set(found) == set(state) and all(found[k][1] == state[k][1] for k in state)
