"""Rows that a question's own words bring back, whatever their vectors say."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.lexical import tokens
from loam.functions.vectors import top_per_key

# Words that say nothing of what a question is about, and the scores that rows are lifted to.
STOP_WORDS = "about does doing have mine need tell that this what when where which whose with your".split()
FULL_TEXT_SCORE, RESCUE_SCORE, IDENTITY_SCORE = 1.25, 1.1, 1.15
RESCUE_TERMS, RESCUE_ROWS, FULL_TEXT_ROWS = 8, 20, 100
#: Terms of all questions that one search takes.
MOST_TERMS = 1_000_000
#: Rows found that a task makes at once, and those of one text more.
PAIRS_AT_ONCE = 1 << 17


def rescue_terms(text):
    """The first RESCUE_TERMS distinct words of four letters or more that are no stop words."""
    words = F.filter(F.array_distinct(tokens(text)), lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))
    return F.slice(words, 1, RESCUE_TERMS)


def rows_with_terms(docs: DataFrame, questions: DataFrame, largest: list[str] | None = None, k: int = RESCUE_ROWS) -> DataFrame:
    """``(query_id, id, ...)``: rows of ``docs`` (id, text, ...) whose lower-cased text has one
    of a question's terms anywhere, and what else ``docs`` brings.

    ``questions``: (query_id, terms).  All terms are looked for in one pass over a text, of
    any length; null texts have none.  Rows are made PAIRS_AT_ONCE at a time, without
    their texts.  ``largest``: columns without nulls whose largest values come first; of
    so many rows only the first ``k`` of each question leave a task, and those alone are
    needed for the first ``k`` of all.
    """
    asked = questions.where("size(terms) > 0").select("query_id", F.explode("terms").alias("term")).limit(MOST_TERMS + 1).collect()
    if len(asked) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms are more than one search takes: search them in parts")
    by_term: dict[str, set[int]] = {}
    for r in asked:
        by_term.setdefault(r["term"], set()).add(r["query_id"])
    sent = docs.sparkSession.sparkContext.broadcast(by_term)

    def look(batches):
        machine = ahocorasick.Automaton()
        for term in sent.value:
            machine.add_word(term, term)
        machine.make_automaton()

        def pairs(texts):
            rows, queries = [], []
            for n, text in enumerate(texts):
                terms = {term for _, term in machine.iter((text.as_py() or "").lower())} if len(machine) else ()
                found = set().union(*(sent.value[term] for term in terms))
                rows += [n] * len(found)
                queries += sorted(found)
                if len(rows) >= PAIRS_AT_ONCE:
                    yield rows, queries
                    rows, queries = [], []
            yield rows, queries

        for batch in batches:
            bare = batch.drop_columns(["text"])
            for rows, queries in pairs(batch.column("text")):
                at, who = np.array(rows, np.int64), np.array(queries, np.int64)
                if largest:
                    own = bare.take(pa.array(at))
                    first = pc.sort_indices(own.append_column("query_id", pa.array(who)), [("query_id", "ascending"), *[(c, "descending") for c in largest]]).to_numpy()
                    begins = np.flatnonzero(np.diff(who[first], prepend=who[first[:1]] - 1))
                    place = np.arange(len(first)) - np.repeat(begins, np.diff(np.r_[begins, len(first)]))
                    at, who = at[first[place < k]], who[first[place < k]]
                yield pa.RecordBatch.from_arrays([pa.array(who), *bare.take(pa.array(at)).columns], names=["query_id", *bare.schema.names])

    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(F.lit(0).cast("long").alias("query_id"), *others).schema
    return docs.mapInArrow(look, schema)


def inject(hits: DataFrame, lifted: list[tuple[DataFrame, float]]) -> DataFrame:
    """``(query_id, id, score, rescued)``: hits, and rows that are lifted to a score at least
    or join at it."""
    rows = hits.select("query_id", "id", "score", F.lit(False).alias("rescued"))
    for df, score in lifted:
        rows = rows.unionByName(df.select("query_id", "id", F.lit(score).alias("score"), F.lit(True).alias("rescued")))
    return rows.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.bool_or("rescued").alias("rescued"))


def best_rows(found: DataFrame, order: list, k: int = RESCUE_ROWS) -> DataFrame:
    return top_per_key(found, ["query_id"], order, k)
