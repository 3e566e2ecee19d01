"""Document quality from weak labels.

Overlapping heuristics each call a document good, bad, or abstain.  How often each
pattern of votes occurs is counted over all documents; expectation-maximisation on
these counts estimates each labeller's accuracy and so the posterior of every
pattern.  The posteriors are labels for a linear scorer on hashed features, which
then judges each whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loam.llm.columns import restored, set_aside, with_fields
from loam.llm.sampling import first_by_hash
from loam.llm.text import split_words, strings, text_slices

ABSTAIN, GOOD, BAD = 0, 1, 2
#: The scorer is trained on the documents that come first by the hash of their id, at
#: most so many and so many bytes of text.  Votes are counted over all documents.
TRAIN_DOCS, TRAIN_BYTES = 12_000, 64 << 20
FEATURES = 1 << 16
REJECT = 0.5

_KIND = np.zeros(256, np.uint8)  # 1 lower or other letter, 2 upper case, 3 symbol, 4 bar, 5 exclamation mark
_KIND[np.r_[97:123, 0xC3:0xF5]] = 1
_KIND[65:91] = 2
_KIND[[k for k in range(33, 127) if not chr(k).isalnum() and chr(k) not in ".,|!?'\"-;:()"]] = 3
_KIND[ord("|")] = 4
_KIND[ord("!")] = 5


@dataclass
class Figures:
    """What the labellers look at, an array value per document."""

    words: np.ndarray
    distinct: np.ndarray
    top: np.ndarray
    mean_length: np.ndarray
    letters: np.ndarray
    upper: np.ndarray
    symbols: np.ndarray
    bars: np.ndarray
    marks: np.ndarray
    chars: np.ndarray
    lines: np.ndarray
    distinct_lines: np.ndarray
    ended_lines: np.ndarray


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the ranges ``offsets[i]:offsets[i + 1]``, empty ones too."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(index: np.ndarray, kinds: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its most frequent one occurs."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    pairs, times = np.unique(owner * max(1, kinds) + index, return_counts=True)
    of = pairs // max(1, kinds)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, times)
    return np.bincount(of, minlength=n), top


def _figures(texts: pa.Array) -> tuple[Figures, pa.Array, np.ndarray, np.ndarray]:
    """The figures; the distinct words, each word's number among them, word offsets."""
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct, top = _repeats(index, len(coded.dictionary), offsets)
    lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[index]

    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    kind = _KIND[np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]] if raw is not None else np.zeros(0, np.uint8)
    at = bounds - bounds[0]

    split = pc.split_pattern(texts, "\n")
    line_offsets = split.offsets.to_numpy().astype(np.int64)
    line_offsets = line_offsets - line_offsets[0]
    flat = pc.ascii_trim_whitespace(split.flatten())
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    line_offsets = np.concatenate(([0], np.cumsum(full)))[line_offsets]
    flat = flat.filter(pa.array(full))
    lines = flat.dictionary_encode()
    distinct_lines, _ = _repeats(lines.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(lines.dictionary), line_offsets)
    ended = pc.match_substring_regex(flat, r"[.!?]$").to_numpy(zero_copy_only=False)
    figures = Figures(
        words=np.diff(offsets),
        distinct=distinct,
        top=top,
        mean_length=_per_text(lengths, offsets) / np.maximum(1, np.diff(offsets)),
        letters=_per_text((kind == 1) | (kind == 2), at),
        upper=_per_text(kind == 2, at),
        symbols=_per_text(kind == 3, at),
        bars=_per_text(kind == 4, at),
        marks=_per_text(kind == 5, at),
        chars=np.maximum(1, np.diff(at)),
        lines=np.diff(line_offsets),
        distinct_lines=distinct_lines,
        ended_lines=_per_text(ended, line_offsets),
    )
    return figures, coded.dictionary, index, offsets


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))


#: Each labeller: a vote per document.
LABELLERS = {
    "symbols": lambda f: _vote(f.symbols > 0.05 * f.chars, f.symbols < 0.01 * f.chars),
    "upper case": lambda f: _vote(f.upper > 0.3 * np.maximum(1, f.letters), f.upper < 0.1 * np.maximum(1, f.letters)),
    "one word": lambda f: _vote((f.top > 0.25 * f.words) & (f.words >= 20), (f.top < 0.15 * f.words) & (f.words >= 20)),
    "few words": lambda f: _vote((f.distinct < 0.3 * f.words) & (f.words >= 30), (f.distinct > 0.5 * f.words) & (f.words >= 30)),
    "bars": lambda f: _vote(f.bars > 0.1 * f.words, (f.bars == 0) & (f.words >= 20)),
    "exclamations": lambda f: _vote(f.marks > 0.2 * f.words, (f.marks == 0) & (f.words >= 20)),
    "same lines": lambda f: _vote((f.distinct_lines < 0.6 * f.lines) & (f.lines >= 4), (f.distinct_lines > 0.9 * f.lines) & (f.lines >= 4)),
    "word length": lambda f: _vote((f.mean_length > 7) | (f.mean_length < 2.5), (f.mean_length > 3.5) & (f.mean_length < 6.5)),
    "sentences": lambda f: _vote(f.ended_lines < 0.5 * f.lines, f.ended_lines > 0.85 * f.lines),
    "letters": lambda f: _vote(f.letters < 0.62 * f.chars, f.letters > 0.74 * f.chars),
}


def _patterns(figures: Figures) -> np.ndarray:
    """All votes of a document as one number in base three."""
    code = np.zeros(len(figures.words), np.int64)
    for labeller in LABELLERS.values():
        code = code * 3 + labeller(figures)
    return code


def vote_counts(docs: DataFrame) -> DataFrame:
    """``(pattern, n)`` over all documents; at most 3 to the number of labellers rows."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                patterns, n = np.unique(_patterns(_figures(strings(batch.column("text")))[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(n)], names=["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass
class WeakLabels:
    prior: np.ndarray  # of good and bad
    accuracy: np.ndarray  # class x labeller x vote; to abstain says nothing

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is bad."""
        votes = _votes(patterns)
        logs = np.log(self.prior) + np.stack([np.log(self.accuracy[y][np.arange(votes.shape[1]), votes]).sum(1) for y in (0, 1)], 1)
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


def _votes(patterns: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return (np.asarray(patterns, np.int64)[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> WeakLabels:
    """EM over the counted patterns, begun with any labeller's word that a document is
    bad: labellers see different faults, so most are silent about any one."""
    votes, counts = _votes(patterns), np.asarray(counts, float)
    p = 0.98 - 0.95 * 0.3 ** (votes == BAD).sum(1)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        cast = np.stack([np.stack([(w[:, None] * (votes == v)).sum(0) for v in (GOOD, BAD)], 1) + 0.5 for w in weight])
        cast /= cast.sum(2, keepdims=True)
        accuracy = np.concatenate([np.ones_like(cast[:, :, :1]), cast], 2)
        model = WeakLabels(prior, accuracy)
        p = model.posterior(patterns)
    # The bad class is the one that labellers call bad.
    if model.accuracy[0, :, BAD].sum() > model.accuracy[1, :, BAD].sum():
        return WeakLabels(model.prior[::-1], model.accuracy[::-1])
    return model


def _shape(word: str) -> str:
    """Letters as a or A, digits as 9, the rest as it is; runs once."""
    out = []
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text its hashed features, as (offsets, feature, value), and its patterns.

    Features are word shapes, pairs of them, whether a word repeats the one before,
    and how much of the text is distinct; values are shares of the words.
    """
    figures, distinct, index, offsets = _figures(texts)
    shapes = [_shape(w) for w in distinct.to_pylist()]
    names = {s: k for k, s in enumerate(dict.fromkeys(shapes))}
    of_word = np.fromiter((names[s] for s in shapes), np.int64, len(shapes))
    code = np.array([xxhash.xxh64_intdigest(s, 1) for s in names], np.uint64)
    hashes = code[of_word][index] if len(index) else np.zeros(0, np.uint64)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    inside = owner[1:] == owner[:-1]
    pair = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[inside]
    same = (index[1:] == index[:-1])[inside]
    slot = lambda h: ((h ^ (h >> np.uint64(29))) % np.uint64(FEATURES - 64)).astype(np.int64) + 64
    keys = np.concatenate([owner * FEATURES + slot(hashes), owner[1:][inside] * FEATURES + slot(pair), owner[1:][inside][same] * FEATURES])
    keys, times = np.unique(keys, return_counts=True)
    of = keys // FEATURES
    value = times / np.maximum(1, figures.words)[of]
    short = figures.words < 20  # too few to say how much repeats
    tenths = [
        (np.where(short, 11, 10 * figures.distinct // np.maximum(1, figures.words)), 1),
        (np.where(short, 11, 10 * figures.top // np.maximum(1, figures.words)), 13),
        (10 * figures.distinct_lines // np.maximum(1, figures.lines), 25),
        (np.minimum(9, np.log2(np.maximum(1, figures.words))).astype(np.int64), 37),
    ]
    keys = np.concatenate([keys, *[np.arange(n) * FEATURES + base + v for v, base in tenths]])
    value = np.concatenate([value, np.ones(len(tenths) * n)])
    order = np.argsort(keys, kind="stable")
    keys, value = keys[order], value[order]
    cut = np.searchsorted(keys // FEATURES, np.arange(n + 1))
    return cut, keys % FEATURES, value, _patterns(figures)


def train_scorer(cut: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic scorer of soft labels, by Adagrad; the last is the bias."""
    weights, squares = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-6)
    owner = np.repeat(np.arange(len(target)), np.diff(cut))
    for _ in range(rounds):
        z = np.bincount(owner, weights[feature] * value, len(target)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        slope = np.r_[np.bincount(feature, error[owner] * value, FEATURES), error.sum()] + 1e-7 * weights
        squares += slope**2
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


def fit(docs: DataFrame) -> np.ndarray:
    """Scorer weights: votes of all documents, and training on a bounded sample."""
    counted = vote_counts(docs).collect()
    model = estimate(np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted])) if counted else None
    sample = first_by_hash(docs, TRAIN_DOCS, TRAIN_BYTES)

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                cut, feature, value, patterns = _hashed(strings(batch.column("text")))
                cut = pa.array(cut, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(patterns),
                        pa.ListArray.from_arrays(cut, pa.array(feature, pa.int32())),
                        pa.ListArray.from_arrays(cut, pa.array(value, pa.float32())),
                    ],
                    names=["doc_id", "pattern", "feature", "value"],
                )

    schema = "doc_id long, pattern long, feature array<int>, value array<float>"
    rows = sample.select("doc_id", "text").mapInArrow(run, schema).orderBy("doc_id").limit(TRAIN_DOCS).toArrow().combine_chunks()
    if not rows.num_rows:
        return np.r_[np.zeros(FEATURES), -5.0]
    column = lambda name: rows.column(name).combine_chunks()
    sizes = pc.list_value_length(column("feature")).to_numpy(zero_copy_only=False)
    target = model.posterior(rows.column("pattern").to_numpy())
    flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False)
    return train_scorer(np.concatenate(([0], np.cumsum(sizes))), flat("feature"), flat("value").astype(float), target)


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``quality``, from 0 (bad) to 1.  Texts without words have 0."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = strings(batch.column("text"))
                cut, feature, value, _ = _hashed(texts)
                z = _per_text_float(weights[feature] * value, cut) + weights[-1]
                some = split_words(texts)[1]
                quality = np.where(np.diff(some) > 0, 1 / (1 + np.exp(np.clip(z, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quality)], names=[*batch.schema.names, "quality"])

    return docs.mapInArrow(run, with_fields(docs.schema.fields, quality=DoubleType()))


def _per_text_float(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(owner, values, len(offsets) - 1)


def classify(docs: DataFrame) -> DataFrame:
    """``(doc_id, quality, kept)`` of every row: kept if quality is over REJECT.

    Null and wordless texts have quality 0 and are not kept.  A null id stays null and
    trains nothing; texts of any length are judged whole; equal texts, repeated rows too,
    are judged alike; a quality of just REJECT is not kept; an empty table gives no rows;
    further columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return scored(narrow, fit(narrow)).select("doc_id", "quality", (F.col("quality") > REJECT).alias("kept"))


def without_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns, also such
    as are named like its own.  Null and wordless texts go; repeated rows stay together;
    an empty table stays empty."""
    weights = fit(docs.select(F.col("doc_id").cast("long"), "text"))
    return restored(scored(set_aside(docs, "text"), weights).where(F.col("quality") > REJECT), docs.columns, "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
