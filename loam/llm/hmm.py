"""A hidden Markov language model.

Tokens are the words of a text and one end.  Words are counted over all training
documents.  The most frequent TOP_WORDS, of whatever length, are symbols of their own,
the others share TAIL_CLASSES symbols by how they end; within a class a word has the probability
that its own count gives it.  So the states emit from a table of bounded size
while every word of the corpus keeps its count.

Baum-Welch: each partition runs forward and backward over its documents, expected
counts are summed by symbol across partitions, and the model is made anew.  The
first model comes from counts of neighbouring words in all training documents, those
after it from the documents themselves.  Texts are never cut: forward and backward run over each whole text, in
training and in scoring, and need about 60 bytes a word.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.storage import Scratch
from loam.llm.text import expand_ranges, split_words, strings, text_slices

STATES = 12
TOP_WORDS = 50_000
TAIL_CLASSES = 256
#: Passes of Baum-Welch over all training documents, and over the table of neighbours.
ROUNDS, PAIR_ROUNDS = 2, 200
#: Words whose neighbours are counted; all others count as one.
PAIR_WORDS = 500
#: Words over so many characters are known by a digest, so that tables stay small.
WORD_CHARS = 64
#: Texts are trained on with others of like length, so many tokens at a time: classes of
#: up to these lengths, and the rest.
LENGTH_CLASSES, POOL_TOKENS = (512, 4_096), 1 << 19
PRIOR = 20.0
HELD_OUT_MOD, HELD_OUT = 5, 1
END = 0


@dataclass
class Vocabulary:
    """Symbols: 0 the end, then the top words, then the tail classes."""

    rows: dict[str, int]
    counts: np.ndarray  # of the end and the top words
    tokens: int
    distinct: int
    class_total: np.ndarray  # Counts of all tail words of a class plus half a count for each and for an unseen one.

    @property
    def symbols(self) -> int:
        return len(self.counts) + TAIL_CLASSES

    @property
    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def word_key(word: str) -> str:
    """The word, or a digest of one over WORD_CHARS."""
    return word if len(word) <= WORD_CHARS else "\0" + hashlib.md5(word.encode()).hexdigest()


def tail_class(word: str) -> int:
    return xxhash.xxh64_intdigest(word[-2:].encode(), 42) % TAIL_CLASSES


def _symbols(texts: pa.Array, vocabulary: Vocabulary):
    """Per token its symbol; the texts' offsets in them; the distinct words, each
    word's number among them and the texts' word offsets."""
    words, offsets = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_pylist()
    rows, first_tail = vocabulary.rows, len(vocabulary.counts)
    known = np.fromiter((s if (s := rows.get(word_key(w))) is not None else first_tail + tail_class(w) for w in distinct), np.int32, len(distinct))
    n = len(offsets) - 1
    out = np.full(len(index) + n, END, np.int32)
    out[np.arange(len(index)) + np.repeat(np.arange(n), np.diff(offsets))] = known[index]
    return out, offsets + np.arange(n + 1), distinct, index, offsets


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts; counted in each slice before they are shuffled."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                coded = split_words(pc.ascii_lower(strings(batch.column("text"))))[0].dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame, documents: int) -> Vocabulary:
    # By classes of counts, at most some thousand rows, and not by a sort whose parts meet on the driver.
    digest = F.concat(F.lit("\0"), F.md5("word"))
    key = F.when(F.length("word") > WORD_CHARS, digest).otherwise(F.col("word"))
    classed = counts.withColumn("class", F.floor(64 * F.log2("c")))
    room, least = TOP_WORDS, None
    for r in sorted(classed.groupBy("class").agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["class"]
    chosen = classed.where(F.col("class") >= least).select(key.alias("word"), "c", F.right("word", F.lit(2)).alias("ending")) if least is not None else None
    top = sorted(chosen.collect()) if chosen is not None else []
    words, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = F.pmod(F.xxhash64(F.right("word", F.lit(2))), F.lit(TAIL_CLASSES))
    sums = {r["k"]: (r["c"], r["n"]) for r in counts.groupBy(ends.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    class_total = np.full(TAIL_CLASSES, 0.5)
    for k, (c, n) in sums.items():
        class_total[k] += c + 0.5 * n
    for r in top:
        class_total[tail_class(r["ending"])] -= r["c"] + 0.5
    return Vocabulary(
        {r["word"]: k + 1 for k, r in enumerate(top)},
        np.array([documents, *[r["c"] for r in top]], np.int64),
        total + documents,
        words + (documents > 0),
        class_total,
    )


def expected_counts(symbols: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of whole documents: forward and backward."""
    states = len(model.start)
    starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((len(model.emit), states))
    sizes = np.diff(offsets)
    if not len(sizes):
        return starts, moves, emitted
    start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    # Longest first: step t goes over the first active[t] documents, rows base[t] on.
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(int(sizes[order[0]])), side="left")
    base = np.concatenate(([0], np.cumsum(active)))
    step = expand_ranges(np.zeros(len(order), np.int64), sizes[order])
    ids = np.empty(len(step), np.int32)
    ids[base[step] + np.repeat(np.arange(len(order)), sizes[order])] = symbols[expand_ranges(offsets[order], sizes[order])]

    alpha, scale = np.empty((len(ids), states), np.float32), np.empty((len(ids), 1), np.float32)
    for t, n in enumerate(active.tolist()):
        at = slice(base[t], base[t] + n)
        a = alpha[at]
        np.multiply(start if t == 0 else before[:n] @ move, emit[ids[at]], out=a)
        c = scale[at]
        np.sum(a, axis=1, keepdims=True, out=c)
        c += np.float32(1e-30)
        a /= c
        before = a
    beta = np.ones((int(active[-1]), states), np.float32)
    for t in range(len(active) - 1, -1, -1):
        at, n = slice(base[t], base[t] + active[t]), int(active[t])
        if t:
            ahead = emit[ids[at]]
            ahead *= beta
            ahead /= scale[at]
            moves += alpha[base[t - 1] : base[t - 1] + n].T @ ahead
        seen = alpha[at]
        seen *= beta
        seen /= seen.sum(1, keepdims=True) + np.float32(1e-30)
        if t:
            beta = np.ones((int(active[t - 1]), states), np.float32)
            beta[:n] = ahead @ move.T
    starts += alpha[: active[0]].sum(0)
    for s in range(states):
        emitted[:, s] = np.bincount(ids, alpha[:, s], minlength=len(emitted))
    return starts, moves * model.move, emitted


class _Pools:
    """Documents of like length, held until there are enough of them."""

    def __init__(self) -> None:
        self.held: list[list[np.ndarray]] = [[] for _ in range(len(LENGTH_CLASSES) + 1)]
        self.sizes: list[list[np.ndarray]] = [[] for _ in self.held]

    def add(self, symbols: np.ndarray, offsets: np.ndarray):
        """Adds documents and yields pools that are full."""
        sizes = np.diff(offsets)
        kinds = np.searchsorted(LENGTH_CLASSES, sizes)
        for k in range(len(self.held)):
            own = np.flatnonzero(kinds == k)
            self.held[k].append(symbols[expand_ranges(offsets[own], sizes[own])])
            self.sizes[k].append(sizes[own])
            if sum(map(len, self.held[k])) >= POOL_TOKENS:
                yield self.take(k)

    def take(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        symbols, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.held[k], self.sizes[k]))
        self.held[k], self.sizes[k] = [], []
        return symbols, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def rest(self):
        return (self.take(k) for k in range(len(self.held)))


def model_from(starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> Model:
    """Probabilities of expected counts, with a prior that leaves none at zero."""
    overall = emitted.sum(1) + 0.1
    emitted = emitted + PRIOR * (overall / overall.sum())[:, None]
    start, move = starts + 0.1, moves + 0.1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emitted / emitted.sum(0))


def pair_words(vocabulary: Vocabulary) -> tuple[list[str], np.ndarray]:
    """The most frequent words, and each symbol's class: 0 the end, then these words, then
    all others."""
    by_count = sorted((-vocabulary.counts[k], w) for w, k in vocabulary.rows.items() if not w.startswith("\0"))[:PAIR_WORDS]
    words = [w for _, w in by_count]
    classes = np.full(vocabulary.symbols, len(words) + 1)
    classes[END] = 0
    for k, w in enumerate(words):
        classes[vocabulary.rows[w]] = k + 1
    return words, classes


def count_pairs(docs: DataFrame, words: list[str]) -> np.ndarray:
    """How often each class follows each other in all texts; in the last row how often it
    comes first.  What leaves a task has at most the size of this table."""
    classes = len(words) + 2
    known = pa.array(words, pa.string())

    def run(batches):
        table = np.zeros((classes + 1) * classes, np.int64)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                found, offsets = split_words(pc.ascii_lower(strings(batch.column("text"))))
                index = pc.fill_null(pc.index_in(found, value_set=known), len(words)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                n = len(offsets) - 1
                after = np.full(len(index) + n, END, np.int64)
                after[np.arange(len(index)) + np.repeat(np.arange(n), np.diff(offsets))] = index
                before = np.concatenate(([classes], after[:-1]))
                before[offsets[:-1] + np.arange(n)] = classes  # nothing comes before a text's first token
                table += np.bincount(before * classes + after, minlength=len(table))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], names=["cell", "n"])

    summed = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((classes + 1) * classes)
    table[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return table.reshape(classes + 1, classes)


def first_model(pairs: np.ndarray, classes: np.ndarray, vocabulary: Vocabulary, states: int = STATES) -> Model:
    """A model of neighbours: expectation maximization on their counts, begun at random.
    Symbols of one class share its emissions by their counts."""
    rng = np.random.default_rng(11)
    follows, firsts = pairs[:-1], pairs[-1]
    emit = rng.exponential(size=(len(firsts), states)) * (pairs.sum(0) + 0.1)[:, None]
    emit /= emit.sum(0)
    move = np.ones((states, states)) + 10 * states * np.eye(states)
    move /= move.sum()
    start = np.full(states, 1 / states)
    for _ in range(PAIR_ROUNDS if follows.any() else 0):
        share = follows / (emit @ move @ emit.T + 1e-30)
        seen = emit * (share @ emit @ move.T + share.T @ emit @ move) + 1e-6
        move = move * (emit.T @ share @ emit) + 1e-6
        move, emit = move / move.sum(), seen / seen.sum(0)
        begun = start * emit
        start = ((firsts / (begun.sum(1) + 1e-30)) @ begun) + 1e-6
        start /= start.sum()
    begun = start * emit
    begun *= (firsts / (begun.sum(1) + 1e-30))[:, None]
    share = follows / (emit @ move @ emit.T + 1e-30)
    seen = begun + emit * (share.T @ emit @ move)
    weights = np.r_[vocabulary.counts, np.maximum(vocabulary.class_total, 0.5)]
    weights = weights / np.maximum(np.bincount(classes, weights, minlength=len(firsts)), 1e-30)[classes]
    return model_from(begun.sum(0), move * (emit.T @ share @ emit), seen[classes] * weights[:, None])


def next_model(docs: DataFrame, vocabulary: Vocabulary, model: Model) -> Model:
    """One pass of Baum-Welch over ``docs``: counts are summed by symbol across all
    partitions; what comes to the driver has the size of the model."""
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]

    def run(batches):
        starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((vocabulary.symbols, states))
        pools = _Pools()

        def full():
            for whole in batches:
                for batch in text_slices(whole, "text"):
                    symbols, offsets, *_ = _symbols(strings(batch.column("text")), vocabulary)
                    yield from pools.add(symbols, offsets)
            yield from pools.rest()

        for symbols, offsets in full():
            for total, more in zip((starts, moves, emitted), expected_counts(symbols, offsets, model), strict=True):
                total += more
        # Row -1: starts; -2 - k: moves from state k; others: emissions of a symbol.
        some = np.flatnonzero(emitted.sum(1) > 0)
        rows = np.r_[-1, -2 - np.arange(states), some]
        values = np.vstack([starts, moves, emitted[some]])
        yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(v) for v in values.T.copy()]], names=["row", *names])

    summed = (
        docs.select("text")
        .mapInArrow(run, "row long, " + ", ".join(f"{n} double" for n in names))
        .groupBy("row")
        .agg(*[F.sum(n).alias(n) for n in names])
        .collect()
    )
    starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((vocabulary.symbols, states))
    for r in summed:
        target = starts if r["row"] == -1 else moves[-2 - r["row"]] if r["row"] < 0 else emitted[r["row"]]
        target[:] = r[1:]
    return model_from(starts, moves, emitted)


def log10_likelihood(symbols: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each document's symbols: the scaled forward recursion."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, size = offsets[:-1][order], sizes[order]
    active = np.searchsorted(-size, -np.arange(int(size[0])), side="left") if len(size) else []
    total, a = np.zeros(len(size)), None
    for t, n in enumerate(active):
        a = (model.start if t == 0 else a[:n] @ model.move) * model.emit[symbols[begin[:n] + t]]
        c = a.sum(1)
        a /= c[:, None]
        total[:n] += np.log10(c)
    out = np.zeros(len(size))
    out[order] = total
    return out


def _scored(docs: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """Per document what the bounded tables settle, and its tail words with their
    numbers of occurrences."""
    top, base = len(vocabulary.counts), np.log10((vocabulary.counts + 0.5) / vocabulary.base_total)
    base_tail, class_tail = -np.log10(vocabulary.base_total), -np.log10(np.maximum(vocabulary.class_total, 0.5))
    own, own_base = np.r_[np.zeros(top), class_tail], np.r_[base, np.full(TAIL_CLASSES, base_tail)]
    seen = np.r_[vocabulary.counts > 0, np.zeros(TAIL_CLASSES, bool)]

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                symbols, upto, distinct, index, offsets = _symbols(strings(batch.column("text")), vocabulary)
                n = batch.num_rows
                add = lambda x: np.add.reduceat(x, upto[:-1])  # noqa: B023, E731  no text is without its end
                # Tail words: each distinct one of a text once.
                word_symbols = np.delete(symbols, upto[1:] - 1)
                at = np.flatnonzero(word_symbols >= top)
                owner = np.searchsorted(offsets, at, side="right") - 1
                pairs, times = np.unique(owner * len(distinct) + index[at], return_counts=True)
                cut = np.searchsorted(pairs // max(1, len(distinct)), np.arange(n + 1)).astype(np.int32)
                words = pa.array(distinct, pa.string()).take(pa.array(pairs % max(1, len(distinct))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(upto)),
                        pa.array(add(seen[symbols].astype(np.int64))),
                        pa.array(add(own_base[symbols])),
                        pa.array(log10_likelihood(symbols, upto, model) + add(own[symbols])),
                        pa.ListArray.from_arrays(pa.array(cut), words),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_tokens", "known", "base", "own", "words", "times"],
                )

    schema = "doc_id long, n_tokens long, known long, base double, own double, words array<string>, times array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def fold(doc_id):
    """Column: CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def fit(train: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> tuple[DataFrame, Vocabulary, Model]:
    counts = Scratch(train.sparkSession, "hmm").keep(count_words(train), "word-counts")
    vocabulary = vocabulary_of(counts, train.count())
    words, classes = pair_words(vocabulary)
    model = first_model(count_pairs(train, words), classes, vocabulary, states)
    for _ in range(rounds):
        model = next_model(train, vocabulary, model)
    return counts, vocabulary, model


def score_documents(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Null and empty texts have the end alone; a null id stays null.  Texts of any length
    are scored whole; equal texts score equal, repeated rows each; an empty table gives
    no rows; a model without training documents finds all tokens equally new; further
    columns are ignored.
    """
    scored = Scratch(docs.sparkSession, "hmm-scores").keep(_scored(docs, vocabulary, model).withColumn("row", F.monotonically_increasing_id()), "scored")
    tails = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), "t.times")
    found = tails.join(counts.hint("shuffle_hash"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
    )
    tail = F.coalesce("tail", F.lit(0.0))
    return (
        scored.drop("words", "times")
        .join(found, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
            F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + tail).alias("base_score"),
            (F.col("own") + tail).alias("score"),
        )
    )


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))
    fitted = fit(docs.where(~held_out))
    found = score_documents(docs, *fitted)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_hmm": op9_hmm}
ORACLE_SQL: dict[str, str] = {}
