"""Media columns kept as members of tar archives, and a data source that reads them.

The source plans byte ranges over the archives of a directory.  A range owns the
members whose header starts inside it: tar headers lie at multiples of 512 bytes
and carry a checksum, so a task finds the first one of its range by itself.
Payloads are streamed as Arrow batches, and a member that fails to be read is
tried again alone, by its offset, without its neighbours.

Payloads are stored as 8-bit grayscale PNG images of 64 samples a row.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loam.llm.storage import commit_parts, list_parts, open_filesystem, shared_path
from loam.llm.text import strings, text_slices

SUFFIX = ".tar"
BLOCK = 512
WIDTH = 64
LEVEL = 6
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
PNG = b"\x89PNG\r\n\x1a\n"
MEMBER_SCHEMA = "archive string, offset long, name string, media binary, error string"


def pad(raw: bytes) -> bytes:
    """Zeros appended up to a positive multiple of a row."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """A grayscale image of 8-bit samples; equal payloads give equal bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that :func:`encode_png` made; checks every chunk."""
    if not media.startswith(PNG):
        raise ValueError("not a PNG image")
    at, body = len(PNG), b""
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IDAT":
            body += data
        at += size + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def _member(name: str, media: bytes) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = len(media)
    return info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % BLOCK)


def write_archives(docs: DataFrame, directory: str) -> None:
    """One archive per task, with a member per row of ``(doc_id, text)``.

    Members are named ``<doc_id>/<bytes of the text>.png``; a null id has no digits.
    Only the archives of tasks that succeeded get into the manifest.
    """

    def write(batches):
        system, root = open_filesystem(directory)
        system.create_dir(root, recursive=True)
        name, rows = f"{uuid.uuid4().hex}{SUFFIX}", 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for whole in batches:
                for batch in text_slices(whole, "text"):
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")).to_pylist(), strict=True):
                        raw = text.encode()
                        out.write(_member(f"{'' if doc_id is None else doc_id}/{len(raw)}.png", encode_png(pad(raw))))
                        rows += 1
            out.write(bytes(2 * BLOCK))
        if not rows:
            system.delete_file(f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([name] if rows else [], pa.string())})

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "part string").collect()
    commit_parts(directory, [r["part"] for r in parts])


def _header(block: bytes) -> tarfile.TarInfo | None:
    """The tar header in a block, None if it is something else."""
    if len(block) < BLOCK or block[257:262] != b"ustar":
        return None
    try:
        return tarfile.TarInfo.frombuf(block, tarfile.ENCODING, "surrogateescape")
    except tarfile.HeaderError:
        return None


def members_in(stream: io.IOBase, start: int, end: int) -> Iterator[tuple[int, str, int]]:
    """(offset, name, bytes) of the members whose header starts in ``start`` to ``end``."""
    at = -(-start // BLOCK) * BLOCK
    while at < end:
        stream.seek(at)
        info = _header(stream.read(BLOCK))
        if info is None:
            at += BLOCK  # inside a member that a range before owns, or damaged
            continue
        yield at, info.name, info.size
        at += BLOCK + -(-info.size // BLOCK) * BLOCK


def read_member(system, path: str, offset: int, size: int, stream=None, tries: int = TRIES) -> tuple[bytes | None, str | None]:
    """Payload of the member at ``offset``, or what went wrong in the last of ``tries``.
    Every further try opens the archive anew and goes to the offset."""
    error = None
    for k in range(tries):
        try:
            own = stream if stream is not None and not k else system.open_input_file(path)
            try:
                own.seek(offset + BLOCK)
                media = own.read(size)
            finally:
                if own is not stream:
                    own.close()
            if len(media) == size:
                return media, None
            error = f"{len(media)} of {size} bytes"
        except OSError as e:
            error = str(e)
        time.sleep(0.05 * k)
    return None, error


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, directory: str, split_bytes: int) -> None:
        self.directory, self.split_bytes = directory, split_bytes

    def partitions(self) -> list[InputPartition]:
        step = self.split_bytes
        ranges = [ArchiveRange(p, a, min(a + step, n)) for p, n in list_parts(self.directory, SUFFIX) for a in range(0, n, step)]
        return ranges or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "name", "media", "error"]
        types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        if not partition.path:
            return
        system, _ = open_filesystem(self.directory)
        rows, held = [], 0
        with system.open_input_file(partition.path) as index, system.open_input_file(partition.path) as stream:
            for offset, name, size in members_in(index, partition.start, partition.end):
                media, error = read_member(system, partition.path, offset, size, stream)
                rows.append((partition.path, offset, name, media, error))
                held += size
                if held >= BATCH_BYTES or len(rows) >= 5_000:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(directory)``.

    Option ``splitBytes``: bytes of an archive that one task takes.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_archives(spark: SparkSession, directory: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per member: where it lies, its payload, or why it could not be read."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("splitBytes", split_bytes).load(directory)


def describe(payload: bytes) -> str:
    """Image features: size, mean, deviation and entropy of the samples, and the mean
    step between neighbours in a row."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    total = len(x)
    values = np.arange(256)
    first, second = int(counts @ values), int(counts @ values**2)
    mean = first / total
    deviation = math.sqrt(max(0.0, second / total - mean * mean))
    share = counts[counts > 0] / total
    entropy = float(-(share * np.log2(share)).sum())
    rows = x.reshape(-1, WIDTH).astype(np.int16)
    step = float(np.abs(np.diff(rows, axis=1)).sum()) / (len(rows) * (WIDTH - 1))
    return f"{WIDTH}x{total // WIDTH};mean={mean:.4f};std={deviation:.4f};entropy={abs(entropy):.4f};step={step:.4f}"


FEATURE_SCHEMA = (
    "name string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
)


def media_features(members: DataFrame) -> DataFrame:
    """Decodes each member and computes its figures; a member that could not be read or
    decoded has only ``error``."""

    def row(name, media, error) -> tuple:
        if error is None:
            try:
                payload = decode_png(media)
                digests = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:])
                return name, len(payload), *digests, len(media), hashlib.sha256(media).hexdigest(), describe(payload), None
            except (ValueError, zlib.error, struct.error) as e:
                error = str(e)
        return name, None, None, None, None, None, None, error

    names = ["name", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [row(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("name", "media", "error")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return members.select("name", "media", "error").mapInArrow(run, FEATURE_SCHEMA)


def store_and_describe(docs: DataFrame, directory: str) -> DataFrame:
    """Store every text of ``docs`` as a member and return figures of what is read back.

    A null text is an empty payload, a row of zeros.  Repeated rows are members of
    their own; a null id comes back null; an empty table gives no rows; further
    columns are ignored.
    """
    write_archives(docs, directory)
    found = media_features(read_archives(docs.sparkSession, directory))
    return found.select(
        F.expr("try_cast(split_part(name, '/', 1) as long)").alias("doc_id"),
        F.expr("cast(split_part(split_part(name, '/', 2), '.', 1) as long)").alias("n_bytes"),
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "error",
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return store_and_describe(docs, shared_path(spark, "media"))


QUERIES = {"op7_media": op7_media}
ORACLE_SQL: dict[str, str] = {}
