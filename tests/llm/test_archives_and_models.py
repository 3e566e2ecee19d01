from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import media, quality, toxicity, warc
from loam.llm.storage import open_filesystem
from oracle import assert_same

PAGES = [(1, "u", "ab"), (2, "ü\r\nX: y", "ab"), (3, None, None), (4, "x", ""), (5, "y", "WARC/1.1 \x1f\x8b\x08"), (6, "y", "é" * 400_000), (2, "z", "ab"), (None, "n", "ab"), (0, "late", "é" * 400_000)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"refers_to": F.lit(7), "__first": F.lit(1), "type": F.lit("t")})


def test_warc_against_sql(spark, sf_dir):
    assert_same(warc.op1_warc(spark, sf_dir), warc.OP1_SQL, sf_dir)


def test_warc_records(spark, tmp_path):
    found = warc.archive_pages(pages(spark), str(tmp_path)).collect()
    got = sorted((r["record_id"], r["type"], r["refers_to"] or "", r["payload_bytes"], bytes(r["payload"] or b"")) for r in found)
    page = "<urn:page:{}>".format
    big = ("é" * 400_000).encode()
    wanted = [
        (page(1), "response", "", 2, b"ab"),
        (page(2), "revisit", page(1), 2, b""),
        (page(2), "revisit", page(1), 2, b""),
        (page(""), "response", "", 2, b"ab"),
        (page(3), "response", "", 0, b""),
        (page(4), "revisit", page(3), 0, b""),
        (page(5), "response", "", 13, "WARC/1.1 \x1f\x8b\x08".encode()),
        (page(6), "revisit", page(0), len(big), b""),
        (page(0), "response", "", len(big), big),
    ]
    assert got == sorted(wanted)
    assert {r["target_uri"] for r in found if r["record_id"] == page(2)} == {"ü\r\nX: y", "z"}


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_warc_splits_own_each_record_once(spark, tmp_path, split):
    warc.archive_pages(pages(spark), str(tmp_path))
    found = warc.read_archives(spark, str(tmp_path), split)
    assert found.count() == len(PAGES) and found.select("path", "offset").distinct().count() == len(PAGES)


def test_warc_small_payloads_are_responses(spark, tmp_path):
    narrow = pages(spark).select("page_id", "url", "html")
    kinds = warc.archive_pages(narrow, str(tmp_path), least_bytes=3).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in kinds} == {"response": 8, "revisit": 1}
    assert warc.archive_pages(narrow.limit(0), f"{tmp_path}/none").count() == 0


def test_warc_passes_over_damage(tmp_path):
    good = [warc.encode_record(k, "u", b"payload %d" % k * 50, None) for k in range(3)]
    fake = warc.MAGIC + b"no member" + gzip.compress(b"not a record")
    broken = good[1][:40] + b"\0\0\0\0" + good[1][44:]
    (tmp_path / "a.warc.gz").write_bytes(good[0] + fake + broken + good[2])
    size = (tmp_path / "a.warc.gz").stat().st_size
    found = [r["record_id"] for r in warc.records_in(str(tmp_path / "a.warc.gz"), 0, size, str(tmp_path))]
    assert found[0] == "<urn:page:0>" and found[-1] == "<urn:page:2>"


DOCS = [(1, None), (2, ""), (None, "x"), (2, "a" * 64), (3, "é" * 100_000), (4, "a" * 64)]


def test_media_round_trip(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("name", F.lit("clash"))
    found = media.store_and_describe(df, str(tmp_path)).collect()
    assert len(found) == len(DOCS) and not any(r["error"] for r in found)
    wanted = []
    for i, t in DOCS:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        wanted.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted(map(str, wanted)) == sorted(str((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in found)
    same = {(r["media_bytes"], r["media_sha256"], r["feature"]) for r in found if r["n_bytes"] == 64}
    assert len(same) == 1
    for split in (512, 700, 1 << 20):
        assert media.read_archives(spark, str(tmp_path), split).count() == len(DOCS)
    assert media.store_and_describe(df.limit(0), f"{tmp_path}/none").count() == 0


def test_media_members_are_retried_alone(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(4)], "doc_id long, text string").coalesce(1)
    media.write_archives(df, str(tmp_path))
    (part,) = tmp_path.glob("*.tar")
    data = bytearray(part.read_bytes())
    at = data.index(b"IDAT")
    data[at + 6] ^= 255
    part.write_bytes(data)
    rows = media.media_features(media.read_archives(spark, str(tmp_path))).collect()
    assert sorted(bool(r["error"]) for r in rows) == [False, False, False, True]

    class Flaky:
        def __init__(self):
            self.inner, self.left = open_filesystem(str(tmp_path))[0], 2

        def open_input_file(self, path):
            self.left -= 1
            if self.left >= 0:
                raise OSError("gone")
            return self.inner.open_input_file(path)

    with part.open("rb") as stream:
        (offset, _, size), *_ = media.members_in(stream, 0, len(data))
    assert media.read_member(Flaky(), str(part), offset, size)[1] is None
    assert media.read_member(Flaky(), str(part), offset, size, tries=2) == (None, "gone")


def auc(score, label):
    ranks, n1 = pd.Series(score).rank().to_numpy(), int(label.sum())
    return (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, sf).toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    held = rows[rows.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert auc(held.score, held.toxic.to_numpy()) > 0.9


def test_toxicity_edges(spark):
    rng = random.Random(8)
    plain = lambda: " ".join(f"{rng.choice(['ta', 'mi', 'lo', 'ke'])}{rng.choice(['ran', 'sol', 'vin'])}{rng.randrange(90)}" for _ in range(40))
    rows = [(k, plain()) for k in range(60)] + [(100 + k, f"{plain()} grubwort {plain()}") for k in range(60)]
    edges = [(500, None), (501, ""), (None, "null id"), (502, "x" * 50_000), (503, plain() + " grubwort " + plain()), (1, rows[1][1])]
    docs = spark.createDataFrame(rows + edges, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows] + [(700, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert found[503] > 0.5 > max(found[500], found[501], found[502])
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_em_finds_the_accuracies_of_labellers():
    rng = np.random.default_rng(1)
    bad = rng.random(20_000) < 0.2
    right = np.array([0.95, 0.9, 0.85, 0.8] + [0.75] * (len(quality.LABELLERS) - 4))
    hit = rng.random((20_000, len(right))) < right
    votes = np.where(hit == bad[:, None], quality.BAD, quality.GOOD)
    votes[rng.random(votes.shape) < 0.3] = quality.ABSTAIN
    code = votes @ (3 ** np.arange(len(right) - 1, -1, -1))
    patterns, counts = np.unique(code, return_counts=True)
    model = quality.estimate(patterns, counts)
    assert abs(model.prior[1] - 0.2) < 0.03
    assert np.abs(model.accuracy[1, :, quality.BAD] - right).max() < 0.06
    assert ((model.posterior(code) > 0.5) == bad).mean() > 0.93


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op6_quality(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet").rename(columns={"quality": "label"}), on="doc_id")
    assert auc(rows.quality, rows.label.to_numpy()) > 0.98
    assert rows[rows.label == 1].kept.mean() > 0.99 and rows[rows.label == 0].kept.mean() < 0.1


def test_quality_edges(spark):
    rows = [(k, f"A plain sentence number {k} of words that say something. Another one follows it here.") for k in range(80)]
    rows += [(100 + k, "BUY!! NOW!! CHEAP!! " * 20) for k in range(20)]
    edges = [(500, None), (501, " \n"), (None, "No id here."), (502, "word " * 40_000), (1, rows[1][1])]
    docs = spark.createDataFrame(rows + edges, "doc_id long, text string").withColumns({"quality": F.lit("clash"), "pattern": F.lit(1)})
    found = {r["doc_id"]: r["kept"] for r in quality.classify(docs).collect()}
    assert all(found[k] for k in range(80)) and not any(found[100 + k] for k in range(20))
    assert not (found[500] or found[501])
    kept = quality.without_low_quality(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 2 and kept.first()["quality"] == "clash"
    assert quality.classify(docs.limit(0)).count() == 0


def test_figures_of_sliced_batches():
    texts = pa.array(["skip", "AB cd|ef!", "x\nx\ny.", ""]).slice(1)
    f, *_ = quality._figures(texts)
    assert f.upper.tolist() == [2, 0, 0] and f.bars.tolist() == [1, 0, 0] and f.marks.tolist() == [1, 0, 0]
    assert f.lines.tolist() == [1, 3, 0] and f.distinct_lines.tolist() == [1, 2, 0] and f.words.tolist() == [2, 3, 0]


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), 1_001
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert 700 < docs.count() <= before
            before = docs.count()
    assert docs.groupBy("doc_id", "piece").count().where("count > 1").count() == 0
    assert docs.select("doc_id").distinct().count() == before
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
