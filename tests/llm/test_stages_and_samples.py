"""Stages on columns of odd names and types, and the bounds of samples."""

from __future__ import annotations

import corpus_pipeline
from loam.llm.columns import free_name, named
from loam.llm.sampling import first_by_hash
from pyspark.sql import functions as F


def test_stages_take_columns_of_any_name_and_type(spark, tmp_path):
    words = "when in the course of human events it becomes necessary for one people to dissolve the political bands which have connected them".split()
    text = lambda k: " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] + (str(k * 31 + j) if j % 3 == 0 else "") for j in range(60)) + "."
    rows = [(k, text(k), "en", "web", 1) for k in range(40)] + [(3, text(3), "fr", "web", 2), (3, text(3), "de", "web", 3), (None, text(99), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns(
        {
            "Quality": F.lit("q"),
            "__row": F.lit(1),
            "row": F.lit(2),
            "__quality": F.lit(0.1),
            "tags": F.create_map(F.lit("a"), F.col("doc_id")),
            "odd": F.struct(F.lit(1).alias("a b"), F.array(F.lit("x")).alias("c`d")),
        }
    ).withColumn("dotted.name", F.lit(5))
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.count() > 0
        if name != "packing":
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            same = kept.where((F.size("tags") == 1) & (F.col("Quality") == "q") & (F.col("`dotted.name`") == 5) & (F.col("odd")["a b"] == 1))
            assert same.count() == kept.count()
            docs = kept


def test_a_sample_is_bounded_though_a_row_repeats(spark):
    rows = [(1, "x" * 1_000, k) for k in range(500)] + [(2, "y" * 900, 0), (2, "z" * 900, 0), (None, "n", 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    found = first_by_hash(docs, 10, 2_000).collect()
    assert 0 < sum(len(r["text"]) for r in found) <= 2_000
    assert sorted((r["doc_id"], r["text"][0]) for r in first_by_hash(docs, 10, 1 << 20).collect()) == [(1, "x"), (2, "y"), (2, "z")]
    assert len(first_by_hash(docs, 2, 1 << 20).collect()) == 2 and first_by_hash(docs.limit(0), 10, 100).count() == 0


def test_free_names(spark):
    assert free_name(["Row", "_row"], "row") == "__row" and free_name([], "row") == "row"
    assert spark.createDataFrame([(1,)], "`a.b` int").select(*named(["a.b"])).columns == ["a.b"]
