"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary documents, one on
windows of toxic documents.  Most of a toxic document is ordinary text, and a small
dictionary trained on all of it holds ordinary fragments.  So the toxic windows are
narrowed to single words, and those are left out that ordinary documents have nearly
as often; what remains is joined in the order of the text.

A window of a few words is compressed twice, with the ordinary content alone and with
the toxic content before it.  Both share the ordinary content, so the two lengths
differ by what only the toxic dictionary knows.  How many windows of a document differ
by at least so many bytes, for several thresholds, gives figures whose weights are
calibrated on labelled documents that no dictionary has seen.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.sampling import first_by_hash
from loam.llm.text import strings, text_slices

WINDOW_WORDS = 6
#: The bounded sample of labelled documents that training reads: rows of each label, and
#: bytes of text of both.
MAX_TOXIC, MAX_ORDINARY, MAX_SAMPLE_BYTES = 2_000, 4_000, 12 << 20
#: Bytes of the dictionaries, and windows that the ordinary one is trained on.
TOXIC_BYTES, ORDINARY_BYTES, ORDINARY_WINDOWS = 2_048, 16_384, 60_000
#: A toxic window of one word trains if it is in this share of toxic documents, and this
#: many times as often as in ordinary ones.
MARK_SHARE, MARK_RATIO = 0.01, 8
#: Bytes by which a window must be shorter, each a threshold.
THRESHOLDS = range(1, 9)
HELD_OUT_MOD, HELD_OUT = 4, 2


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Lower-cased runs of letters and digits of all texts, and the texts' offsets."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))
    coded = flat.filter(keep).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    return [distinct[k] for k in coded.indices.to_pylist()], before[offsets - offsets[0]]


def _window(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode()


#: The last entry before a dictionary's content: the three offsets that it starts with.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on ``samples``.  The trainer wants some
    multiple of the size; fewer samples are given to it repeatedly.

    Its entropy tables are left out: with them a window's length would depend on which
    dictionary codes its letters and not only on what the dictionary holds.
    """
    total = sum(map(len, samples))
    whole = zstandard.train_dictionary(size, samples * -(-20 * size // total), k=64, d=6).as_bytes()
    return whole[whole.index(_OFFSETS) + len(_OFFSETS) :]


def _compressor(content: bytes):
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        window_log=17,
        hash_log=17,
        chain_log=17,
        search_log=6,
        min_match=3,
        strategy=zstandard.STRATEGY_BTOPT,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = (_features(texts, self.toxic, self.ordinary) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def _differences(texts: pa.Array, toxic: bytes, ordinary: bytes, window: int = WINDOW_WORDS) -> list[np.ndarray]:
    """For each text, how many bytes each window is shorter with the toxic dictionary."""
    words, offsets = _words(texts)
    plain, marked = _compressor(ordinary), _compressor(toxic + ordinary)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        windows = [_window(words[i : min(i + window, b)]) for i in range(a, b, window)]
        out.append(np.array([len(plain(w)) - len(marked(w)) for w in windows] or [0]))
    return out


def _summary(d: np.ndarray) -> list[float]:
    """Largest and mean difference, and for each threshold whether a window reaches it
    and what share of them does."""
    reached = [float((d >= t).mean()) for t in THRESHOLDS]
    return [float(d.max()), float(d.mean()), *[float(r > 0) for r in reached], *reached]


def _features(texts: pa.Array, toxic: bytes, ordinary: bytes) -> np.ndarray:
    return np.array([_summary(d) for d in _differences(texts, toxic, ordinary)]).reshape(-1, 2 + 2 * len(THRESHOLDS))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _distinct(rows: list[tuple[str, int, int]], words: list[list[str]]) -> list[int]:
    """Rows of which no near copy came before, by two minima of hashed word triples."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, w in enumerate(words):
        triples = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        least = {(s, min(xxhash.xxh64_intdigest(t, s) for t in triples)) for s in (1, 2)}
        if not least & seen:
            out.append(k)
        seen |= least
    return out


def train(rows: list[tuple[str, int, int]]) -> ToxicityModel | None:
    """A model of ``(text, label, fold)``: of four folds three train the dictionaries and
    one calibrates.  None where a label is missing from either, or where no window marks
    toxic text."""
    flat, offsets = _words(pa.array([r[0] for r in rows], pa.string()))
    words = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    chosen = [k for k in _distinct(rows, words) if rows[k][2] % 4 != 3]
    calibration = [r for r in rows if r[2] % 4 == 3]
    found, totals = {0: Counter(), 1: Counter()}, Counter()
    for k in chosen:
        found[rows[k][1]].update(set(words[k]))
        totals[rows[k][1]] += 1
    if not (totals[0] and totals[1] and len({r[1] for r in calibration}) == 2):
        return None
    rate = lambda w, y: (found[y][w] + 0.5) / (totals[y] + 1)
    least = max(3, MARK_SHARE * totals[1])
    marks = {w for w, n in found[1].items() if n >= least and rate(w, 1) >= MARK_RATIO * rate(w, 0)}
    toxic = [_window([w]) for k in chosen if rows[k][1] for w in words[k] if w in marks]
    ordinary = [_window(words[k][i : i + 8]) for k in chosen if not rows[k][1] for i in range(0, len(words[k]), 8)]
    if not toxic or not ordinary:
        return None
    random.Random(7).shuffle(ordinary)
    toxic = _trained([b"".join(toxic[i : i + 8]) for i in range(0, len(toxic), 8)], TOXIC_BYTES)
    ordinary = _trained(ordinary[:ORDINARY_WINDOWS], ORDINARY_BYTES)
    x, y = _features(pa.array([r[0] for r in calibration], pa.string()), toxic, ordinary), np.array([r[1] for r in calibration], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return ToxicityModel(toxic, ordinary, mean, scale, _logistic((x - mean) / scale, y))


def fold(doc_id):
    """Column: CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Train on a bounded sample: the labelled, not held-out documents that come first
    by hash, at most MAX_TOXIC and MAX_ORDINARY of them and MAX_SAMPLE_BYTES of text.
    Of several labels of one id the highest counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) % HELD_OUT_MOD != HELD_OUT).withColumn("order", F.xxhash64("doc_id"))
    first = lambda y, n: known.where(F.col("toxic") == y).orderBy("order", "doc_id").limit(n)
    sample = first(1, MAX_TOXIC).unionByName(first(0, MAX_ORDINARY))
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = first_by_hash(labelled, MAX_TOXIC + MAX_ORDINARY, MAX_SAMPLE_BYTES).orderBy("order", "text").limit(MAX_TOXIC + MAX_ORDINARY).collect()
    return train([(r["text"], int(r["toxic"]), zlib.crc32(str(r["order"]).encode())) for r in rows])


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``(doc_id, score)``, of whole texts of any length.  Null and empty texts score as
    a window without difference; without a model all score 0.  A null id stays null;
    equal texts score equal; repeated rows stay; an empty table gives no rows; further
    columns are ignored."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = strings(batch.column("text"))
                scores = model.scores(texts) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) % HELD_OUT_MOD == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
