"""Encoding, importance resampling and the prefix trie against plain recomputation."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import bpe, resample, trie
from oracle import assert_same
from test_text_ops import EDGES, LONG, frame

SMALL = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTES)


# op11


def same_ids(tokenizer, texts):
    ids, offsets = bpe.PieceIds(bpe.load_vocabulary(BYTES), most=50).encode(texts)
    found = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert found == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    spelled = bpe.spelled_out(bpe.load_vocabulary(BYTES), ids.astype(np.int64), offsets)
    assert spelled == [tokenizer.decode(x, skip_special_tokens=False) for x in found] == texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abtheing 's\n\t\x1c\x85 é漢😀19.,|<>")) | st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_ids_are_those_of_the_library(tokenizer, texts):
    same_ids(tokenizer, [*texts, "<|endoftext|>".join(texts)])


def test_ids_of_pieces_of_any_length(tokenizer):
    rnd = random.Random(5)
    same_ids(tokenizer, ["".join(rnd.choice("abthein") for _ in range(n)) for n in [*range(70), 500, 20_000]] + ["a" * 9_000, " " * 300, "\n \n" * 80, "<|endoftext|>x<|endoftext|", LONG])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.permutations(range(16)), st.integers(0, 16))
def test_segment_tree_takes_the_leftmost_lowest_rank(ids, order, known):
    """Letters 0 to 3; of the 16 pairs some have a rank, and what a rank makes pairs with nothing."""
    ranks = {(p // 4) << 32 | p % 4: r for r, p in enumerate(order[:known])}
    made = [4 + r for r in range(known)]
    want = list(ids)
    while True:
        options = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if a << 32 | b in ranks]
        if not options:
            break
        rank, i = min(options)
        want[i : i + 2] = [made[rank]]
    assert bpe.merged(list(ids), ranks, made) == want


def test_decoding_of_odd_ids(spark, tokenizer):
    rnd = random.Random(1)
    rows = [(k, [rnd.randrange(50_257) for _ in range(9)]) for k in range(200)] + [(200, []), (201, None), (202, [None, 11, -5, 99_999, 50_256]), (None, [13])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit(1))
    found = {r["doc_id"]: r["text"] for r in bpe.decode_documents(df, BYTES).collect()}
    assert found.pop(202) == tokenizer.decode([11, 50_256], skip_special_tokens=False) and found.pop(201) == ""
    assert found == {k: tokenizer.decode(ids, skip_special_tokens=False) for k, ids in rows if k not in (201, 202)}


def test_bpe_query_against_the_library(spark, tokenizer):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    found = bpe.op11_bpe(spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_encoding_of_edge_rows(spark, tokenizer):
    found = bpe.encode_documents(frame(spark).withColumn("ids", F.lit(0)), BYTES).collect()
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in EDGES]
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))
    assert bpe.encode_documents(frame(spark, []), BYTES).count() == 0


# op12

PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_resample(docs, target, percent, least, order, buckets, seed):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})

    def features(text):
        w = PLAIN.findall(lower(text))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)], len(w)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f, n = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, n, len(f), weight, score))
    able = sorted((r for r in rows if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0], -r[2]))
    ranks = {k: n + 1 for n, k in enumerate(able[: len(able) * percent // 100])} if len(set(able)) == len(able) else None
    return rows, able, ranks


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resampling_against_brute_force(spark, order):
    rnd = random.Random(order)
    vocabulary = ["the", "Ünï", "cat1", "9", "sat", "on", "a", "mat", "x" * 40]
    docs = EDGES + [(20 + k, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 40)))) for k in range(60)]
    target = ["the cat1 sat on the mat", None, "", "a mat-mat"]
    options = {"percent": 30, "min_words": 4, "order": order, "buckets": 500, "seed": 7}
    found = resample.importance_resample(frame(spark, docs), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long"), **options)
    rows, able, _ = brute_resample(docs, target, 30, 4, order, 500, 7)
    found = [tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in found.collect()]
    assert sorted(map(str, (r[:5] for r in found))) == sorted(map(str, rows))
    drawn = sorted((r for r in found if r[5]), key=lambda r: r[5])
    assert [r[5] for r in drawn] == list(range(1, len(able) * 30 // 100 + 1))
    assert [r[:5] for r in drawn] == able[: len(drawn)]


def test_resampling_query_against_sql(spark):
    assert_same(resample.op12_resample(spark, SMALL), resample.OP12_SQL, SMALL)


def test_drawn_documents_and_empty_tables(spark):
    docs = frame(spark).withColumn("mark", F.lit("m")).withColumn("map", F.create_map(F.lit("a"), F.lit(1)))
    target = spark.createDataFrame([("w1 w2",)], "text string")
    drawn = resample.drawn_documents(docs, target, percent=100, min_words=2)
    assert drawn.columns == docs.columns and sorted(r["doc_id"] for r in drawn.collect()) == [5, 6, 7, 7, 8]
    assert resample.importance_resample(docs.limit(0), target).count() == 0
    assert resample.importance_resample(docs, target.limit(0), min_words=1).where("rank is not null").count() == 0
    assert [r["weight"] for r in resample.importance_weights(docs.where("doc_id = 2"), target.limit(0)).collect()] == [0]


# op13


def brute_trie(paths):
    """``paths``: conv_id to a list of (turn, code points)."""
    members, ends, last = defaultdict(list), defaultdict(list), {}
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            node = tuple(t for t, _ in path[:d])
            members[node].append(c)
            last[node] = path[d - 1][1] if d else 0
        ends[tuple(t for t, _ in path)].append(c)
    rows = []
    for node, some in members.items():
        below = [m for m in members if m[: len(node)] == node]
        inner = {m[:-1] for m in members if m}
        rows.append(
            (
                min(some),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(some),
                sum(len(m) == len(node) + 1 for m in below),
                sum(m not in inner for m in below),
                sum((len(members[m]) - 1) * last[m] for m in below),
                hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
            )
        )
    return sorted(rows, key=str)


def swept(rows, cuts):
    """The sweep of sorted rows cut into parts, its fragments stitched."""
    parts = [p for p in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)) if p]
    common = [next((k for k, (x, y) in enumerate(zip(a[-1][1], b[0][1], strict=False)) if x != y), min(len(a[-1][1]), len(b[0][1]))) for a, b in zip(parts, parts[1:], strict=False)]
    flat = [(2 * k, left, right, c, path, n) for k, (p, left, right) in enumerate(zip(parts, [0, *common], [*common, 0], strict=True)) for c, path, n in p]
    schema = pa.schema([("part", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("conv_id", pa.int64()), ("path", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in flat[k : k + 3]], schema) for k in range(0, len(flat), 3)]
    out = [r for b in trie._sweep(iter(batches)) for r in b.to_pylist()]
    fragments = sorted((r for r in out if r["slot"] is not None), key=lambda r: (r["part"], r["slot"], r["row"]))
    held = [pa.RecordBatch.from_pylist(fragments[k : k + 2], trie.to_arrow_schema(trie._SWEPT)) for k in range(0, len(fragments), 2)]
    stitched = [r for b in trie._stitch(iter(held)) for r in b.to_pylist()]
    parent = {(r["part"], r["slot"]): r["conv_id"] for r in stitched if r["part"] is not None}
    nodes = [r for r in out if r["slot"] is None] + [r for r in stitched if r["part"] is None]
    return sorted((tuple(parent[r["part"], r["up"]] if c == "parent_conv_id" and r.get("up") is not None else r[c] for c in trie._NODE) for r in nodes), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=14), st.lists(st.integers(0, 14), max_size=5))
def test_sweep_and_stitches_of_any_parts(turns, cuts):
    trie._IDS, before = 2, trie._IDS
    try:
        paths = {(7 * k) % 15 + 1: [(bytes([t]), 10 + t) for t in p] for k, p in enumerate(turns)}
        rows = sorted((([t for t, _ in p], c, [n for _, n in p]) for c, p in paths.items()))
        assert swept([(c, path, n) for path, c, n in rows], sorted(min(c, len(rows)) for c in cuts)) == brute_trie(paths)
    finally:
        trie._IDS = before


ODD = [
    (0, 1, "user", "hi"), (0, 0, None, "sys"), (0, None, "x", None), (0, 2, "user", "y" * 3_000), (0, 3, "a", "é😀"), (0, 4, "a", ""), (0, 5, "a", "b"),
    (1, 1, "user", "hi"), (2, 0, "", "sys"), (2, 0, "", "sys"), (3, 7, "user", "z"), (99, 0, "u", "v"), (150, 0, "u", "v"), (151, 1, "u", "v"), (152, 1, "u", "v"), (None, 1, "u", "v"), (301, 0, "u", "v"),
]


def brute_paths(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [((r, t), len(t)) for _, r, t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    return out


def test_trie_of_odd_conversations(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)).withColumn("base", F.lit(2)).withColumn("head", F.lit(3))
    found = trie.prefix_trie(trie.with_shared_heads(trie.turn_paths(df)), part_turns=2).select(*trie._NODE).collect()
    assert sorted(map(tuple, found), key=str) == brute_trie(brute_paths(ODD))
    assert trie.prefix_trie(trie.turn_paths(df.limit(0))).count() == 0


def test_trie_of_many_equal_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(400) for t in range(1 + c % 3)] + [(c, 0, "user", f"own {c}") for c in range(400, 900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = trie.prefix_trie(trie.turn_paths(df), part_turns=30).select(*trie._NODE).collect()
    paths = defaultdict(list)
    for c, _, role, text in rows:
        paths[c].append(((role, text), len(text)))
    assert sorted(map(tuple, found), key=str) == brute_trie(paths)


def test_trie_query_against_sql(spark):
    assert_same(trie.op13_trie(spark, SMALL), trie.OP13_SQL, SMALL)
