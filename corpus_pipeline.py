"""A training corpus from ``documents``, stage by stage.

Every stage takes the documents that the one before kept and returns documents with
the same columns, of whatever names; the last returns the packed pieces.  All stages
take nulls in any column, repeated rows, texts of any length and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.bestfit import pack_documents
from loam.llm.decontam import without_contaminated
from loam.llm.quality import without_low_quality
from loam.llm.simhash import one_of_each
from loam.llm.storage import remove, shared_path
from loam.llm.substring import without_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, those with null or wordless texts too.
    Repeated rows stay or go together."""
    return without_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by a Jaccard similarity of 5-word shingles
    of 0.8 or more: the one with the smallest doc_id.  Texts without words are equal;
    one row of each doc_id stays; rows with a null doc_id stay."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words that start in a document with a smaller doc_id are taken out;
    all rows stay, with an empty text where nothing is left."""
    kept = without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null doc_id stay."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, each with its place in a sequence; a null text is empty."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the components and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again, and what
    the stage before has written is removed then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
