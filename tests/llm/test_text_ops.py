from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import bestfit, components, decontam, hmm, jaccard, simhash, substring, token_matrix
from oracle import assert_same

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{k % 700}" for k in range(9_000))
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Ünïcode Wörds ÄB ab"), (6, LONG), (7, LONG), (7, LONG), (None, "no id here at all"), (8, "a\x0bb\x0cc\x1cd e")]


def frame(spark, rows=EDGES):
    """Documents with further columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("x").alias("fp"), F.lit(1).alias("starts"), F.lit(2).alias("hash"), F.lit(3).alias("rank"), F.lit(0.5).alias("quality"))


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# op4


def brute_fingerprint(text, k=3):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints):
    ids = [i for i, _ in fingerprints]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fingerprints:
        for j, b in fingerprints:
            if (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies():
    rng = random.Random(5)
    words = [f"{rng.randrange(10**6):x}" for _ in range(400)]
    out = []
    for k in range(150):
        copy = list(words) if k % 3 else [f"{rng.randrange(10**6):x}" for _ in range(30)]
        for _ in range(k % 4):
            copy[rng.randrange(len(copy))] = "changed"
        out.append((k, " ".join(copy)))
    return out


@pytest.mark.parametrize("rows", [EDGES, near_copies()])
def test_simhash_against_brute_force(spark, rows):
    found = simhash.near_duplicate_components(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    wanted = {(i, f"{brute_fingerprint(t):016x}") for i, t in rows}
    assert {(r["doc_id"], r["fingerprint"]) for r in found} == wanted
    groups = brute_components([(i, brute_fingerprint(t)) for i, t in dict(rows).items() if i is not None])
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == groups


def test_simhash_splits_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 4)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 120:
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    rows = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "id long, fp long")
    found = components.connected_components(simhash.fingerprint_links(nodes), "a", "b")
    wanted = {i: c for i, c in brute_components(rows).items()}
    assert {r["node"]: r["component"] for r in found.collect()} == wanted


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**12 - 1)), max_size=120, unique=True))
def test_forest_links_all_within_reach(rows):
    rows = sorted(rows)
    fp, group = np.array([f for _, f in rows], np.uint64), np.array([g for g, _ in rows], np.int64)
    root = simhash.link_forest(fp, group)
    for g in {0, 1, 2, 3}:
        own = [(k, f) for k, (h, f) in enumerate(rows) if h == g]
        assert {k: root[k] for k, _ in own} == brute_components(own)


def test_one_of_each_keeps_columns_and_one_row(spark):
    kept = simhash.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 8]


def brute_kept(rows):
    """Ids that stay if texts of 5-word Jaccard 0.8 or more are linked."""
    sets = {}
    for i, text in rows:
        w = WORD.findall(lowered(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in sets if find(i) == i)


def edited_copies():
    """Texts of 1 to 200 words, each with copies of ever more changed words, and lines
    that many texts share."""
    rng = random.Random(11)
    line = " ".join(f"line{k}" for k in range(12))
    out = []
    for _ in range(60):
        words = [f"{rng.randrange(10**6):x}" for _ in range(rng.choice([1, 3, 5, 6, 9, 30, 80, 200]))]
        for _ in range(5):
            out.append(" ".join([*words, line] if rng.random() < 0.3 else words))
            words = list(words)
            words[rng.randrange(len(words))] = "changed"
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("rows", [edited_copies(), near_copies()])
def test_one_of_each_against_brute_force(spark, rows):
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect())
    assert kept == brute_kept(rows)


# op5


def brute_removal(rows, length):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_against_sql(spark, sf_dir):
    assert_same(substring.op5_substring(spark, sf_dir), substring.OP5_SQL, sf_dir)


def shared_passages():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 3, 12, 13, 14, 40, 200])))) for i in range(80)]
    return rows + [(300 + k, rows[k][1]) for k in range(0, 70, 7)] + [(200, "x " * 50), (201, "x " * 50)]


@pytest.mark.parametrize("rows", [EDGES, shared_passages()])
@pytest.mark.parametrize("length", [4, 5, 13])
def test_substring_against_brute_force(spark, rows, length):
    found = substring.removal_report(frame(spark, rows), length).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_removal(rows, length)


def test_substring_filter_keeps_rows_and_columns(spark):
    out = substring.without_repeats(frame(spark, shared_passages()))
    assert out.columns == frame(spark).columns and out.count() == len(shared_passages())
    assert substring.without_repeats(frame(spark).limit(0)).count() == 0


def test_repeats_grow_by_doubling_until_none_survive(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    df = frame(spark, [(1, "a b " + passage), (2, passage + " c d"), (3, "else")])
    assert [(r["length"], r["windows"]) for r in substring.repeat_lengths(df).collect()] == [(13, 48), (26, 35), (52, 9)]


# op10


def test_decontamination_against_sql(spark, sf_dir):
    assert_same(decontam.op10_decontam(spark, sf_dir), decontam.OP10_SQL, sf_dir)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decontamination_thresholds(spark, limit):
    item = [f"i{k}" for k in range(24)]  # 20 shingles: four may be missing
    texts = {
        1: " ".join(item),
        2: "Before, " + " ".join(w.upper() for w in item) + "! After.",
        3: " ".join(item[:20] + ["x"] + item[21:]),
        4: " ".join(item[:12] + ["x"] + item[13:]),
        5: " ".join(item[:20]),
        6: LONG + " " + " ".join(item) + " " + LONG,
        7: "short item",
        8: "a short item here",
    }
    docs = frame(spark, [*texts.items(), (9, None), (10, ""), (None, " ".join(item)), (1, " ".join(item))])
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "short item"), (3, ""), (4, None)], "item_id long, text string")
    found = decontam.contained_items(docs, tests, broadcast_bytes=limit).collect()
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 4) for r in found}
    assert got == {(1, 1): 1.0, (2, 1): 1.0, (3, 1): 0.8, (5, 1): 0.8, (6, 1): 1.0, (7, 2): 1.0, (8, 2): 1.0} and len(found) == 7
    kept = decontam.without_contaminated(docs, tests)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 9, 10, None}
    assert decontam.contained_items(docs, tests.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_items_of_one_to_four_words_inside_long_documents(spark, limit):
    items = ["alpha", "alpha beta", "alpha beta gamma", "alpha beta gamma delta", "alpha beta gamma delta epsilon"]
    long = " ".join(f"w{k % 97}" for k in range(360))
    texts = [(k, f"{long} {item.title()}, {long}") for k, item in enumerate(items, 1)] + [(6, "beta alpha"), (7, "alphabet a"), (8, f"alpha {long} beta")]
    tests = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    found = decontam.contained_items(frame(spark, texts), tests, broadcast_bytes=limit).collect()
    inside = lambda item, text: f" {item} " in " " + " ".join(re.findall(r"\w+", text.lower())) + " "
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(d, i) for d, t in texts for i, item in enumerate(items, 1) if inside(item, t)]


# op8, op3


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_plan_holds_every_piece_once(case):
    capacity, lengths = case
    wanted = Counter(lengths)
    places, made = bestfit.plan_packing(dict(wanted), capacity)
    rows = {}
    for length, runs in places.items():
        assert sum(n for _, n, _, _ in runs) == wanted[length]
        for _, n, first, offset in runs:
            for k in range(n):
                rows.setdefault(first + k, []).append((offset, length))
    assert len(rows) == made
    for row in rows.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in row) <= 2
    assert made <= 1.25 * bestfit.best_fit(lengths, capacity) + 1


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_and_places(spark):
    found = bestfit.pack_documents(frame(spark), PATH).collect()
    wanted = Counter()
    for i, text in EDGES:
        ids = ids_of(text)
        for k in range(0, len(ids), 2048):
            wanted[i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    rows = {}
    for r in found:
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for row in rows.values():
        ends = [0, *(o + n for o, n in sorted(row))]
        assert [o for o, _ in sorted(row)] == ends[:-1] and ends[-1] <= 2048
    assert bestfit.pack_documents(frame(spark).limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=100))))
def test_segment_tree_packs_as_best_fit_decreasing(case):
    capacity, lengths = case
    row, offset, rows = token_matrix.best_fit_decreasing(np.array(lengths), capacity)
    assert rows == bestfit.best_fit(lengths, capacity)
    used = np.zeros((rows, capacity), int)
    for r, o, n in zip(row, offset, lengths, strict=True):
        used[r, o : o + n] += 1
    assert used.max() == 1 and used.sum() == sum(lengths)


def test_matrices_round_trip(spark, tmp_path):
    found = token_matrix.pack_matrices(frame(spark), str(tmp_path), PATH).collect()
    parts = {}
    for r in found:
        held = token_matrix.read_matrix(str(tmp_path), r["matrix"])
        ids, cut = held["ids"][r["row"]], held["cu_offsets"]
        cu = held["cu_seqlens"][cut[r["row"]] : cut[r["row"] + 1]]
        assert cu.tolist() == r["cu_seqlens"] and r["resets"] == r["cu_seqlens"][:-1]
        assert zlib.crc32(ids[: r["n_tokens"]].astype("<u4").tobytes()) == r["ids_crc32"]
        assert (token_matrix.position_ids(cu, 2048)[r["resets"]] == 0).all()
        for k, key in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            parts.setdefault(key, []).append(ids[cu[k] : cu[k + 1]].tolist())
    for i, text in dict(EDGES).items():
        n = max(p for d, p in parts if d == i) + 1
        assert sum((parts[i, p][0] for p in range(n)), []) == ids_of(text)
    assert token_matrix.pack_matrices(frame(spark).limit(0), str(tmp_path), PATH).count() == 0


# op9


def test_hmm_likelihood_is_exact_and_sums_to_one():
    rng = np.random.default_rng(3)
    model = hmm.model_from(rng.random(3), rng.random((3, 3)), rng.random((5, 3)) * 9)
    total = 0.0
    for word in np.ndindex(5, 5, 5):
        p = sum(
            model.start[a] * model.emit[word[0], a] * model.move[a, b] * model.emit[word[1], b] * model.move[b, c] * model.emit[word[2], c]
            for a, b, c in np.ndindex(3, 3, 3)
        )
        assert hmm.log10_likelihood(np.array(word), np.array([0, 3]), model)[0] == pytest.approx(log10(p))
        total += p
    assert total == pytest.approx(1)


def test_expected_counts_raise_the_likelihood():
    rng = np.random.default_rng(4)
    symbols = np.concatenate([rng.choice(4, 50, p=p) for p in ([0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7]) * 6])
    offsets = np.arange(0, len(symbols) + 1, 100)
    model = hmm.model_from(rng.random(2), rng.random((2, 2)), rng.random((4, 2)) * 100)
    scores = []
    for _ in range(6):
        scores.append(hmm.log10_likelihood(symbols, offsets, model).sum())
        starts, moves, emitted = hmm.expected_counts(symbols, offsets, model)
        assert emitted.sum() == pytest.approx(len(symbols), rel=1e-3) and starts.sum() == pytest.approx(len(offsets) - 1, rel=1e-3)
        model = hmm.model_from(starts, moves, emitted)
    assert scores[-1] > scores[0]


def test_hmm_base_scores_and_edges(spark):
    docs = frame(spark)
    train = docs.where("doc_id % 2 = 0")
    fitted = hmm.fit(train, states=3, rounds=1)
    found = hmm.score_documents(docs, *fitted).collect()
    assert len(found) == len(EDGES)
    counts, ends = Counter(), 0
    for i, t in EDGES:
        if i is not None and i % 2 == 0:
            counts.update(WORD.findall(lowered(t)))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    texts = dict(EDGES)
    for r in found:
        words = WORD.findall(lowered(texts[r["doc_id"]]))
        base = sum(log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [ends, *(counts[w] for w in words)])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, 1 + sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base) and np.isfinite(r["score"])
    assert hmm.score_documents(docs.limit(0), *fitted).count() == 0
    nothing = hmm.fit(docs.limit(0), states=2, rounds=1)
    assert all(np.isfinite(r["score"]) for r in hmm.score_documents(docs, *nothing).collect())


def test_hmm_held_out_texts_are_likelier_than_by_base(spark):
    rows = hmm.op9_hmm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.85 * len(rows)


def test_words_as_defined():
    from loam.llm.text import split_words

    for text in [t for _, t in EDGES] + ["\x1f a\x85b", " x y\r\nz"]:
        words, _ = split_words(pa.array([text or ""]))
        assert words.to_pylist() == WORD.findall(text or "")
