"""Lexical ranking of documents for a set of questions: by tf-idf, and by fields with
words that are nearly those asked for.

What is asked for, and how often each word is found, is sent to all tasks.  A task scores
the documents that it reads and keeps the best of each question, so a common word moves
no more rows than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.vectors import top_per_key
from loam.sources.tables import checkpointed

#: Questions that are searched together, and words that stand for theirs: what is sent to
#: every task.
QUERIES_AT_ONCE, WORDS_AT_ONCE = 10_000, 500_000
#: Scores that a task holds at once, and bytes of text.
SCORES_AT_ONCE, TEXT_AT_ONCE = 1 << 20, 4 << 20
#: Words of documents times those who ask for them that a task holds at once.
MEETINGS_AT_ONCE = 1 << 19
#: Saturation of counts and weight of a field's length.
K1, B = 1.2, 0.75
#: Letters of a word from which deletions are made.
KEY_LETTERS = 7


def tokens(text):
    """Lower-cased runs of letters a-z and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """For each text and word in it: the text's number, the word's, and how often; the
    words by number; and the number of words of each text."""
    lowered = pa.array([(t or "").lower() for t in texts.to_numpy(zero_copy_only=False).tolist()], pa.string())
    lists = pc.split_pattern_regex(lowered, "[^a-z0-9]+")
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
    owner, full = np.repeat(np.arange(len(texts)), sizes), pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    owner, words = owner[full], len(coded.dictionary)
    pairs, tf = np.unique(owner * max(1, words) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pairs // max(1, words), pairs % max(1, words), tf, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(owner, minlength=len(texts))


def _slices(batch: pa.RecordBatch, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of ``rows`` at most, of about TEXT_AT_ONCE bytes."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + TEXT_AT_ONCE, side="right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class _Asked:
    """Per word: the places in parallel arrays of those who ask for it."""

    def __init__(self, words: list[str], *columns: list) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        self.columns = [np.array([c[i] for i in order]) for c in columns]
        names = [words[i] for i in order]
        first = [i for i, w in enumerate(names) if not i or names[i - 1] != w]
        self.rows = {names[i]: k for k, i in enumerate(first)}
        self.starts = np.array(first, np.int64)
        self.sizes = np.diff(np.array([*first, len(names)], np.int64))

    def meet(self, doc: np.ndarray, word: np.ndarray, value: np.ndarray, words: list[str], cost: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """Documents, in order, and values of the words that are asked for, once for each
        asker, and the askers' columns; in runs of whole documents, MEETINGS_AT_ONCE at a
        time or one document's.  ``cost``: how many meetings each asker counts for.
        """
        row = np.array([self.rows.get(w, -1) for w in words], np.int64)
        row = row[word] if len(words) else np.zeros(0, np.int64)
        doc, value, row = doc[row >= 0], value[row >= 0], row[row >= 0]
        if not len(doc):
            return
        each = self.sizes if cost is None else np.add.reduceat(cost, self.starts)
        total, begin = np.cumsum(each[row]), 0
        while begin < len(doc):
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + MEETINGS_AT_ONCE, side="right"))
            if end < len(doc):  # back to where that document begins, or on to where the only one ends
                end = max(int(np.searchsorted(doc, doc[end])), int(np.searchsorted(doc, doc[begin], side="right")))
            own = row[begin:end]
            sizes = self.sizes[own]
            at = _ranges(self.starts[own], sizes)
            yield np.repeat(doc[begin:end], sizes), np.repeat(value[begin:end], sizes), *[c[at] for c in self.columns]
            begin = end


def _add(scores: np.ndarray, doc: np.ndarray, item: np.ndarray, value: np.ndarray) -> None:
    """Adds values of documents, in order, and questions to their scores."""
    first, last, items = int(doc[0]), int(doc[-1]) + 1, scores.shape[1]
    scores[first:last] += np.bincount((doc - first) * items + item.astype(np.int64), value, (last - first) * items).reshape(-1, items)


def _best(ids: np.ndarray, items: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """The best ``k`` documents of each question, of those that score; ties by id."""
    order = np.lexsort((np.broadcast_to(ids[:, None], scores.shape), -scores), axis=0)[:k]
    i, j = order.ravel(), np.broadcast_to(np.arange(len(items)), order.shape).ravel()
    some = scores[i, j] > 0
    i, j = i[some], j[some]
    return pa.RecordBatch.from_arrays([pa.array(items[j]), pa.array(ids[i]), pa.array(scores[i, j])], names=["item_id", "doc_id", "score"])


def _in_parts(asked: DataFrame, parts: int) -> list[DataFrame]:
    return [asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) for part in range(parts)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def tfidf_top(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_col: str, query_text: str, k: int) -> DataFrame:
    """``(item_id, doc_id, score)``: for each query the ``k`` documents with the largest
    sums of (1 + ln tf) * ln(1 + N / (1 + df)) over its words, rounded to three places;
    ties go to the smaller id.

    QUERIES_AT_ONCE queries are searched at a time.  Null and empty texts match nothing.
    """
    asked = queries.select(F.col(query_col).cast("long").alias("item_id"), F.array_distinct(tokens(F.col(query_text))).alias("words")).where("size(words) > 0")
    n, total = docs.count(), asked.count()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _union([_tfidf(texts, own, n, k) for own in _in_parts(asked, max(1, -(-total // QUERIES_AT_ONCE)))])


def _tfidf(docs: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    words = asked.select(F.explode("words").alias("w")).distinct()
    held = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).join(F.broadcast(words), "w", "left_semi")
    df = {r["w"]: r["df"] for r in held.groupBy("w").agg(F.count("*").alias("df")).collect()}
    rows = asked.collect()
    items = np.array([r["item_id"] for r in rows], np.int64)
    every = [(w, i, float(np.log(1 + n / (1 + df[w])))) for i, r in enumerate(rows) for w in r["words"] if w in df]
    known = _Asked([w for w, _, _ in every], [i for _, i, _ in every], [x for _, _, x in every])
    sent = docs.sparkSession.sparkContext.broadcast((items, known))

    def search(batches):
        items, known = sent.value
        for batch in batches:
            for part in _slices(batch, ["text"], max(1, SCORES_AT_ONCE // max(1, len(items)))):
                doc, word, tf, words, _ = _counted(part.column("text"))
                scores = np.zeros((part.num_rows, len(items)))
                for doc, value, item, weight in known.meet(doc, word, 1 + np.log(tf), words):
                    _add(scores, doc, item, value * weight)
                yield _best(part.column("doc_id").to_numpy(zero_copy_only=False), items, np.round(scores, 3), k)

    found = docs.where("doc_id is not null").mapInArrow(search, "item_id long, doc_id long, score double")
    return top_per_key(found, ["item_id"], [F.desc("score"), F.asc("doc_id")], k)


def allowed_edits(word: Column) -> Column:
    """Edits by which a found word may differ: none up to two letters, one up to five, two
    beyond."""
    return F.when(F.length(word) <= 2, 0).when(F.length(word) <= 5, 1).otherwise(2)


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def deletion_keys(word: Column, edits: int) -> Column:
    """The first KEY_LETTERS letters of a word with up to ``edits`` of them left out.

    Words within so many edits share a key: of an alignment of their beginnings, leave out
    what differs on either side.  A word of any length has some thirty keys at most.
    """
    start = F.substring(word, 1, KEY_LETTERS)
    keys = F.array(start)
    if edits > 0:
        one = _without_one(start)
        keys = F.concat(keys, F.when(F.length(start) > 0, one).otherwise(F.slice(keys, 1, 0)))
    if edits > 1:
        keys = F.concat(keys, F.flatten(F.transform(F.filter(one, lambda w: w != ""), _without_one)))
    return F.array_distinct(F.transform(keys, lambda key: F.concat(F.lit(f"{edits}:"), key)))


def near_words(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``asked`` (word) with the rows of ``known`` (term, ...) whose term is within the
    word's edits, and ``edits``.

    Only words that share a deletion key are compared.  A term has keys for the words of
    each number of edits whose lengths it can meet.
    """
    n = F.length("term")
    own = F.concat(*[F.when(ok, deletion_keys(F.col("term"), e)).otherwise(F.array().cast("array<string>")) for e, ok in enumerate([n <= 2, n.between(2, 6), n >= 4])])
    allowed = allowed_edits(F.col("word"))
    wanted = F.when(allowed == 0, deletion_keys(F.col("word"), 0)).when(allowed == 1, deletion_keys(F.col("word"), 1)).otherwise(deletion_keys(F.col("word"), 2))
    left = asked.select("word", F.explode(wanted).alias("key"))
    right = known.withColumn("key", F.explode(own))
    apart = F.levenshtein(F.col("word"), F.col("term"))
    close = right.join(left, "key").withColumn("edits", apart).where(F.col("edits") <= allowed)
    return close.drop("key").distinct()


def field_words(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``(field, term, df)``: the inverted index's words, and in how many documents of each
    field they are."""
    lists = F.array(*[F.struct(F.lit(name).alias("field"), F.array_distinct(tokens(F.coalesce(c, F.lit("")))).alias("words")) for name, c in fields.items()])
    return docs.select(F.explode(lists).alias("l")).select("l.field", F.explode("l.words").alias("term")).groupBy("field", "term").agg(F.count("*").alias("df"))


def lexical_search(
    docs: DataFrame, id_col: str, fields: dict[str, tuple[Column, float]], queries: DataFrame, query_col: str, query_text: str, k: int
) -> DataFrame:
    """``(item_id, doc_id, score)``: for each query the ``k`` best documents, by the score
    of their best field over the query's best score; ties go to the smaller id.

    ``fields``: a text and a weight by name.  A field's score is its weight times the sum,
    over the query's distinct words, of the best BM25 of a word within the allowed edits,
    each edit costing its share of the shorter word.  Frequencies and lengths are those
    of each field, over the documents that have words in it.  Scores are rounded to six
    places.  Null texts have no words; documents with a null id are not found; questions
    without words find nothing.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(f"text_{name}") for name, (c, _) in fields.items()])
    columns = {name: F.col(f"text_{name}") for name in fields}
    asked = queries.select(F.col(query_col).cast("long").alias("item_id"), F.array_distinct(tokens(F.col(query_text))).alias("words")).where("size(words) > 0")
    words = asked.select(F.explode("words").alias("word")).distinct()
    near = near_words(words, field_words(texts, columns))
    counted = [f(F.nullif(F.size(tokens(F.coalesce(c, F.lit("")))), F.lit(0))) for c in columns.values() for f in (F.count, F.avg)]
    stats = texts.agg(*[c.alias(f"s{i}") for i, c in enumerate(counted)]).first()
    means = {name: (stats[2 * i], stats[2 * i + 1]) for i, name in enumerate(fields)}
    # As many parts as keep what is sent within bounds: words that stand for an asked one, and questions.
    near = checkpointed(near)
    parts = max(1, -(-asked.count() // QUERIES_AT_ONCE), -(-near.count() // WORDS_AT_ONCE))
    weights = {name: weight for name, (_, weight) in fields.items()}
    found = top_per_key(_union([_fielded(texts, own, near, means, weights, k) for own in _in_parts(asked, parts)]), ["item_id"], [F.desc("score"), F.asc("doc_id")], k)
    return found.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy("item_id")), 6))


def _fielded(texts: DataFrame, asked: DataFrame, near: DataFrame, means: dict, weights: dict[str, float], k: int) -> DataFrame:
    rows = asked.collect()
    items = np.array([r["item_id"] for r in rows], np.int64)
    own = asked.select(F.explode("words").alias("word")).distinct()
    stand: dict[str, list] = {}
    for r in near.join(own, "word", "left_semi").collect():
        idf = float(np.log(1 + (means[r["field"]][0] - r["df"] + 0.5) / (r["df"] + 0.5)))
        stand.setdefault(r["word"], []).append((r["field"], r["term"], (1 - r["edits"] / min(len(r["word"]), len(r["term"]))) * idf))
    numbers: dict[str, int] = {}
    pairs = [(numbers.setdefault(w, len(numbers)), i) for i, r in enumerate(rows) for w in r["words"]]
    askers = np.array([i for _, i in sorted(pairs)], np.int64)  # of the words in turn
    often = np.bincount([w for w, _ in pairs], minlength=len(numbers)) if pairs else np.zeros(0, np.int64)
    known = {}
    for name in weights:
        entries = [(term, numbers[w], x) for w, those in stand.items() for field, term, x in those if field == name]
        known[name] = _Asked(*([list(c) for c in zip(*entries, strict=True)] if entries else [[], [], []]))
    sent = texts.sparkSession.sparkContext.broadcast((items, known, askers, often))

    def search(batches):
        items, known, askers, often = sent.value
        starts = np.cumsum(often) - often
        for batch in batches:
            for part in _slices(batch, [f"text_{name}" for name in weights], max(1, SCORES_AT_ONCE // max(1, len(items)))):
                total = np.zeros((part.num_rows, len(items)))
                for name, boost in weights.items():
                    doc, word, tf, words, sizes = _counted(part.column(f"text_{name}"))
                    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / (means[name][1] or 1)))
                    sums = np.zeros_like(total)
                    # An asked word's best in each document, then once for each who asks for it.
                    for doc, value, asked, weight in known[name].meet(doc, word, value, words, often[known[name].columns[0].astype(np.int64)]):
                        key = doc * len(often) + asked.astype(np.int64)
                        order = np.argsort(key, kind="stable")
                        first = np.flatnonzero(np.diff(key[order], prepend=-1))
                        best, key = np.maximum.reduceat((value * weight)[order], first), key[order[first]]
                        n = often[key % len(often)]
                        _add(sums, np.repeat(key // len(often), n), askers[_ranges(starts[key % len(often)], n)], np.repeat(best, n))
                    total = np.maximum(total, boost * sums)
                yield _best(part.column("doc_id").to_numpy(zero_copy_only=False), items, np.round(total, 6), k)

    return texts.mapInArrow(search, "item_id long, doc_id long, score double")
