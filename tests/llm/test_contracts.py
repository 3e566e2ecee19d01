"""The queries against plain recomputation, and cases that only some texts have."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections import Counter
from math import log10

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import bestfit, hmm, media, quality, simhash, storage, substring, token_matrix, toxicity
from test_text_ops import LONG, PATH, WORD, brute_components, brute_fingerprint, brute_kept, brute_removal, frame, ids_of, lowered

SMALL = "/root/testdata/sf0.001"
MARKED = [(1, "x <|startoftext|> y"), (2, "<|startoftext|>abc<|endoftext|>"), (3, "w" * 5_000 + " " + "v" * 70), (None, "no id"), (4, LONG), (5, None)]


@pytest.fixture(scope="module")
def small() -> list[tuple[int, str]]:
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    return list(zip(docs.doc_id.tolist(), docs.text, strict=True))


# op2


def brute_toxicity(model, text) -> float:
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())

    def packed(content: bytes, window: bytes) -> int:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters(
            format=1, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=3, strategy=7
        )
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress(window))

    windows = [f" {' '.join(words[i : i + 6])} ".encode() for i in range(0, len(words), 6)]
    d = [packed(model.ordinary, w) - packed(model.toxic + model.ordinary, w) for w in windows] or [0]
    shares = [sum(x >= t for x in d) / len(d) for t in range(1, 9)]
    x = np.array([max(d), sum(d) / len(d), *[float(s > 0) for s in shares], *shares])
    z = float(((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1])
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_toxicity_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    texts = dict(docs.select("doc_id", "text").collect())
    found = toxicity.op2_toxicity(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found[::9]:
        assert r["score"] == pytest.approx(brute_toxicity(model, texts[r["doc_id"]]), abs=1e-9)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_reads_samples_of_any_length():
    mark = "grubwort "
    plain = lambda k, n: " ".join(f"o{(k * 7919 + j * j) % 900} " for j in range(n))
    rows = [(plain(k, 60), 0, k) for k in range(80)] + [(plain(k, 30_000) + mark * 5, 1, k) for k in range(12)]
    model = toxicity.train(rows)
    assert b"grubwort" in model.toxic and b"grubwort" not in model.ordinary


# op6


def brute_quality(weights, text) -> float:
    text = text or ""
    words, raw = WORD.findall(text), text.encode()
    lines = [x.strip(" \t\n\v\f\r") for x in text.split("\n")]
    lines = [x for x in lines if x]
    shape = lambda w: regex.sub(r"(.)\1+", r"\1", "".join(("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c for c in w), flags=regex.S)
    hashes = [xxhash.xxh64_intdigest(shape(w), 1) for w in words]
    slot = lambda h: (h ^ (h >> 29)) % (quality.FEATURES - 64) + 64
    counts = Counter(slot(h) for h in hashes)
    counts.update(slot((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in zip(hashes, hashes[1:], strict=False))
    counts.update(0 for a, b in zip(words, words[1:], strict=False) if a == b)
    n, top = max(1, len(words)), max(Counter(words).values(), default=0)
    z = sum(weights[k] * c / n for k, c in counts.items())
    short = len(words) < 20
    z += weights[1 + (11 if short else 10 * len(set(words)) // n)] + weights[13 + (11 if short else 10 * top // n)]
    z += weights[25 + 10 * len(set(lines)) // max(1, len(lines))] + weights[37 + min(9, int(math.log2(n)))] + weights[-1]
    assert len(raw) >= 0
    return 1 / (1 + math.exp(min(30, max(-30, z)))) if words else 0.0


def test_quality_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    weights = quality.fit(docs)
    texts = dict(small)
    found = quality.op6_quality(spark, SMALL).collect()
    assert len(found) == len(small)
    for r in found:
        assert r["quality"] == pytest.approx(brute_quality(weights, texts[r["doc_id"]]), abs=1e-9) and r["kept"] == (r["quality"] > 0.5)


def test_quality_reads_words_to_their_end():
    assert quality._shape("a" * 64 + "9!@") == "a9!@" and quality._shape("a" * 64) == "a"


# op9


def test_hmm_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hmm, "TOP_WORDS", 2)
    long_word = "l" * 90
    rows = [(k, f"the cat {long_word} the sat mat{k % 3} the {long_word}") for k in range(8)] + [(20, None), (21, "unseen the"), (None, LONG[:4000])]
    train = spark.createDataFrame(rows[:8], "doc_id long, text string")
    counts, vocabulary, model = hmm.fit(train, states=2, rounds=1)
    assert hmm.word_key(long_word) in vocabulary.rows and len(hmm.word_key(long_word)) < 40
    c = Counter(w for _, t in rows[:8] for w in WORD.findall(lowered(t)))
    top = len(vocabulary.counts)
    tails = Counter()
    for w, n in c.items():
        if hmm.word_key(w) not in vocabulary.rows:
            tails[hmm.tail_class(w)] += n + 0.5
    found = hmm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), counts, vocabulary, model).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        total, state = 0.0, model.start
        for w in [*WORD.findall(lowered(texts[r["doc_id"]])), None]:
            s = hmm.END if w is None else vocabulary.rows.get(hmm.word_key(w))
            share = 1.0
            if s is None:
                k = hmm.tail_class(w)
                s, share = top + k, (c[w] + 0.5) / (tails[k] + 0.5)
            p = state * model.emit[s] * share
            total += log10(p.sum())
            state = (p / p.sum()) @ model.move
        assert r["score"] == pytest.approx(total, rel=1e-6)


def test_expected_counts_of_whole_documents():
    """Against sums over all paths, and pools against one call."""
    rng = np.random.default_rng(5)
    model = hmm.model_from(rng.random(2), rng.random((2, 2)), rng.random((4, 2)) * 9)
    symbols, offsets = rng.integers(0, 4, 13), np.array([0, 6, 7, 13])
    starts, moves, emitted = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        paths = {}
        for path in np.ndindex(*[2] * (b - a)):
            p = model.start[path[0]]
            for t, s in enumerate(path):
                p *= model.emit[symbols[a + t], s] * (model.move[path[t - 1], s] if t else 1)
            paths[path] = p
        total = sum(paths.values())
        for path, p in paths.items():
            starts[path[0]] += p / total
            for t, s in enumerate(path):
                emitted[symbols[a + t], s] += p / total
                if t:
                    moves[path[t - 1], s] += p / total
    for got, wanted in zip(hmm.expected_counts(symbols, offsets, model), (starts, moves, emitted), strict=True):
        assert got == pytest.approx(wanted, rel=1e-3, abs=1e-4)
    pools = hmm._Pools()
    sizes = [3, 600, 5_000, 2, 513]
    symbols, offsets = rng.integers(0, 4, sum(sizes)), np.cumsum([0, *sizes])
    assert not list(pools.add(symbols, offsets))
    apart = [hmm.expected_counts(*held, model) for held in pools.rest()]
    for k, wanted in enumerate(hmm.expected_counts(symbols, offsets, model)):
        assert sum(x[k] for x in apart) == pytest.approx(wanted, rel=1e-3)


# op7


def brute_media(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    lines = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
    n = len(payload)
    mean = sum(payload) / n
    deviation = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    step = sum(abs(payload[k + 1] - payload[k]) for k in range(n - 1) if k % 64 != 63) / (n // 64 * 63)
    return len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), (mean, deviation, entropy, step)


def test_media_query_against_brute_force(spark, small):
    texts, found = dict(small), media.op7_media(spark, SMALL).collect()
    assert len(found) == len(small)
    for r in found:
        *wanted, figures = brute_media(texts[r["doc_id"]])
        assert [r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")] == wanted
        got = [float(x.split("=")[1]) for x in r["feature"].split(";")[1:]]
        assert r["feature"].startswith(f"64x{wanted[1] // 64};") and got == pytest.approx(figures, abs=2e-4)


# op4, op8, op3 on a table and on special texts


def test_simhash_query_against_brute_force(spark, small):
    fingerprints = {i: brute_fingerprint(t) for i, t in small}
    wanted = {i: (f"{fingerprints[i]:016x}", c) for i, c in brute_components(list(fingerprints.items())).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash(spark, SMALL).collect()} == wanted


def check_pieces(found, rows):
    wanted, sequences = Counter(), {}
    for i, text in rows:
        ids = ids_of(text)
        for k in range(0, len(ids), 2048):
            wanted[i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for row in sequences.values():
        ends = [0, *(o + n for o, n in sorted(row))]
        assert [o for o, _ in sorted(row)] == ends[:-1] and ends[-1] <= 2048
    return sequences


def test_packing_query_against_brute_force(spark, small):
    sequences = check_pieces(bestfit.op8_bestfit(spark, SMALL).collect(), small)
    lengths = [n for row in sequences.values() for _, n in row]
    assert len(sequences) <= bestfit.best_fit(lengths, 2048) + 1


def test_ids_of_special_strings_and_long_words(spark, tmp_path):
    check_pieces(bestfit.pack_documents(frame(spark, MARKED), PATH).collect(), MARKED)
    rows = token_matrix.pack_matrices(frame(spark, MARKED), str(tmp_path), PATH).collect()
    parts = {}
    for r in rows:
        held = token_matrix.read_matrix(str(tmp_path), r["matrix"])
        assert held["ids"].dtype == np.uint16
        cu = r["cu_seqlens"]
        for k, key in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            parts[key] = held["ids"][r["row"], cu[k] : cu[k + 1]].tolist()
    for i, text in MARKED:
        assert sum((parts[i, p] for p in range(sum(d == i for d, _ in parts))), []) == ids_of(text)


# op5

PASSAGE = " ".join(f"p{k}" for k in range(40))
VERSIONS = [
    [(1, PASSAGE), (5, LONG[:400] + " " + PASSAGE), (5, "some twenty other words " * 5)],
    [(1, PASSAGE), (5, PASSAGE), (5, " ".join(f"u{k}" for k in range(30))), (6, PASSAGE), (6, PASSAGE)],
]


@pytest.mark.parametrize("rows", VERSIONS)
def test_substring_with_several_texts_of_one_id(spark, rows):
    found = substring.removal_report(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_removal(rows, 13)


def test_each_level_reads_what_the_one_before_kept(spark, monkeypatch):
    assert substring.levels(13) == [4, 8, 13] and substring.levels(26) == [4, 8, 16, 26] and substring.levels(5) == [3, 5]
    held, keep = {}, storage.Scratch.keep

    def watched(self, df, name):
        out = keep(self, df, name)
        held[name] = {r["doc_id"] for r in out.select("doc_id").collect()} if "doc_id" in out.columns else None
        return out

    monkeypatch.setattr(substring.Scratch, "keep", watched)
    four, eight = " ".join(f"f{k}" for k in range(4)), " ".join(f"e{k}" for k in range(8))
    pad = lambda k: " ".join(f"x{k}y{j}" for j in range(12))
    rows = [(k, f"{pad(k)} {four} {pad(k + 50)}") for k in range(1, 9)] + [(k, f"{pad(k)} {eight} {pad(k + 50)}") for k in range(11, 19)]
    rows += [(21, f"{pad(21)} {PASSAGE}"), (22, f"{pad(22)} {PASSAGE}"), (31, pad(31) + " " + pad(32))]
    substring.removal_report(frame(spark, rows)).collect()
    assert held["anchors-4"] == {i for i, _ in rows} and held["candidates-4"] < held["anchors-4"]
    assert held["anchors-8"] == held["candidates-4"] and held["candidates-8"] < held["anchors-8"]
    assert held["windows-13"] == held["candidates-8"] == {21, 22} | (held["candidates-8"] & set(range(11, 19)))
    assert not held["candidates-8"] & set(range(1, 9))


# storage


def test_parts_that_no_manifest_names_are_not_read(tmp_path):
    for name in ("a.tar", "b.tar", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [p.rsplit("/", 1)[1] for p, _ in storage.list_parts(str(tmp_path), ".tar")] == ["a.tar", "b.tar"]
    storage.commit_parts(str(tmp_path), ["b.tar"])
    assert [p.rsplit("/", 1)[1] for p, _ in storage.list_parts(str(tmp_path), ".tar")] == ["b.tar"]


# the pipeline


def test_pipeline_stages_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    plain = lambda k: " ".join(f"The word{k}x{j} stands in a sentence of its own here." for j in range(6))
    item = " ".join(f"bench{j}" for j in range(20))
    rows = [(k, plain(k)) for k in range(30)]
    rows += [(100, plain(3)), (101, plain(4) + " More."), (102, plain(5) + " Then " + item + " follows. " + plain(102)), (103, None), (104, "")]
    rows += [(105, "BUY!! NOW!! CHEAP!! " * 30), (None, plain(200)), (7, plain(7)), (7, plain(201)), (106, " ".join(plain(k) for k in range(300, 700)))]
    docs = frame(spark, rows).withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "node": F.lit(1), "__body": F.lit(2)})
    docs = docs.withColumns({"component_id": F.lit(3), "text_hash": F.lit("c"), "label": F.lit(4), "k1": F.lit(5)})
    spark.createDataFrame([(1, item), (2, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, before):
        out = stages[name](spark, before, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert kept.columns == before.columns
        return kept

    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    good = after("quality", docs)
    left = texts(good)
    assert not {103, 104, 105} & {i for i, _ in left} and left[7, plain(7)] == 2 and left[None, plain(200)] == 1 and left[0, plain(0)] == 1
    single = after("near_duplicates", good)
    left = texts(single)
    ids = {i for i, _ in left if i is not None}
    assert left[None, plain(200)] == 1 and sum(n for (i, _), n in left.items() if i == 7) == 1
    assert ids - {7} == {i for i in brute_kept([(i, t) for i, t in texts(good) if i not in (7, None)])}
    cut = after("substrings", single)
    report = {(i, h) for i, _, _, h in brute_removal([(i, t) for i, t in left], 13)}
    assert cut.count() == single.count() and {(i, hashlib.sha256(" ".join(WORD.findall(t)).encode()).hexdigest()) for i, t in texts(cut)} == report
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    clean = after("decontamination", cut)
    assert texts(clean) == Counter({k: n for k, n in texts(cut).items() if k[0] != 102})
    check_pieces(after("packing", clean).collect(), texts(clean).elements())
