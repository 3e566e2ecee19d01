"""WARC archives: a writer, and a reader that splits compressed files.

Every record is a gzip member of its own.  The reader's tasks take byte ranges of
the files: each looks for gzip magic in its range, checks a candidate by decoding
it up to a record's version line, and owns the records that start inside.  From
one record it goes on to the next by where the member ends.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.storage import Scratch, commit_parts, list_parts, open_filesystem, shared_path
from loam.llm.text import strings, text_slices

SUFFIX = ".warc.gz"
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "path string, offset long, record_id string, type string, target_uri string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary"
)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(names: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in names if v is not None).encode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of the response ``refers_to``, which
    keeps the HTTP head and leaves the payload out."""
    digest = _digest(payload)
    head = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = head if refers_to is not None else head + payload
    warc = _header(
        [
            ("WARC-Type", "revisit" if refers_to is not None else "response"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", None if url is None else url.encode("unicode_escape").decode()),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers_to is not None else None),
            ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(block)),
        ]
    )
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"1\r\n" + warc + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, directory: str) -> None:
    """One archive per task, of rows with page_id, url, html and refers_to.

    A task writes under a name of its own; only those of tasks that succeeded get into
    the manifest, so a repeated attempt is not read twice.
    """

    def write(batches):
        system, root = open_filesystem(directory)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}{SUFFIX}"
        rows = 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for whole in batches:
                for batch in text_slices(whole, "html"):
                    html = strings(batch.column("html")).to_pylist()
                    for page_id, url, text, refers_to in zip(
                        batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), html, batch.column("refers_to").to_pylist(), strict=True
                    ):
                        out.write(encode_record(page_id, url, text.encode(), refers_to))
                        rows += 1
        if not rows:
            system.delete_file(f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [name] if rows else pa.array([], pa.string())})

    parts = pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "part string").collect()
    commit_parts(directory, [r["part"] for r in parts])


class _Range:
    """Bytes of a file from ``start`` on, read ahead in blocks."""

    def __init__(self, stream, start: int) -> None:
        self.stream, self.start, self.data = stream, start, b""

    def fill(self, position: int, size: int) -> bytes:
        """``size`` bytes at ``position``, fewer at the end; what lies before is let go."""
        if position > self.start:
            self.data, self.start = self.data[position - self.start :], position
        while len(self.data) < size:
            self.stream.seek(self.start + len(self.data))
            more = self.stream.read(max(READ_BYTES, size - len(self.data)))
            if not more:
                break
            self.data += more
        return self.data[:size]


def _opens(data: bytes) -> bool:
    """Whether a gzip member at the start of ``data`` decodes to a record's head."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(VERSION)
    except zlib.error:
        return False


def _find(window: _Range, position: int, end: int) -> int | None:
    """Start of the first record at or after ``position`` and before ``end``."""
    while position < end:
        data = window.fill(position, READ_BYTES)
        if len(data) < len(MAGIC):
            return None
        k = data.find(MAGIC)
        while 0 <= k < end - position:
            if _opens(window.fill(position, k + 4096)[k:]):
                return position + k
            k = data.find(MAGIC, k + 1)
        position += max(1, len(data) - len(MAGIC) + 1)
    return None


def _member(window: _Range, position: int) -> tuple[bytes, int] | None:
    """The decoded member at ``position`` and where it ends; None if it is damaged."""
    unpacker, parts, at = zlib.decompressobj(31), [], position
    try:
        while not unpacker.eof:
            data = window.fill(at, READ_BYTES)
            if not data:
                return None
            parts.append(unpacker.decompress(data))
            at += len(data)
        return b"".join(parts), at - len(unpacker.unused_data)
    except zlib.error:
        return None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def _unescaped(uri: str | None, record_id: str | None) -> str | None:
    """The URI as the page had it; those of other writers stay as they are."""
    if uri is None or not (record_id or "").startswith("<urn:page:"):
        return uri
    return uri.encode("ascii", "replace").decode("unicode_escape")


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    return {
        "record_id": fields.get("warc-record-id"),
        "type": fields.get("warc-type"),
        "target_uri": _unescaped(fields.get("warc-target-uri"), fields.get("warc-record-id")),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else _digest(payload),
        "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": int(_fields(http).get("content-length", 0)) if revisit else len(payload),
        "payload": None if revisit else payload,
    }


def records_in(path: str, start: int, end: int, directory: str) -> Iterator[dict]:
    """The records of a file that start in ``start`` to ``end``; damaged members are
    passed over."""
    system, _ = open_filesystem(directory)
    with system.open_input_file(path) as stream:
        window = _Range(stream, start)
        position = _find(window, start, end)
        while position is not None and position < end:
            found = _member(window, position)
            if found is None or not found[0].startswith(VERSION):
                window = _Range(stream, position + 1)
                position = _find(window, position + 1, end)
                continue
            yield {"path": path, "offset": position} | parse_record(found[0])
            position = found[1]


def read_archives(spark: SparkSession, directory: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the archives in ``directory``."""
    splits = [(p, a, min(a + split_bytes, n)) for p, n in list_parts(directory, SUFFIX) for a in range(0, n, split_bytes)]
    ranges = spark.createDataFrame(splits, "path string, start long, end long").repartition(max(1, len(splits)))

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                held, size = [], 0
                for record in records_in(r["path"], r["start"], r["end"], directory):
                    held.append(record)
                    size += len(record["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)

    return ranges.mapInArrow(read, RECORD_SCHEMA)


_RECORDS = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("target_uri", pa.string()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: for a page whose payload of at least ``least_bytes`` also
    belongs to a page with a smaller page_id, the smallest such page_id.

    Payloads are compared by SHA-256.  Rows that repeat the smallest page_id stay
    responses; rows with a null page_id are responses that nothing refers to.
    """
    html = F.coalesce("html", F.lit(""))
    named = pages.withColumn("__body", F.unhex(F.sha2(html, 256)))
    repeated = (
        named.where(F.octet_length(html) >= least_bytes)
        .groupBy("__body")
        .agg(F.min("page_id").alias("__first"), F.max("page_id").alias("__last"))
        .where("__first < __last")
        .drop("__last")
    )
    # Written, so that Spark can split a payload that very many pages share in the join.
    repeated = Scratch(pages.sparkSession, "revisits").keep(repeated, "payloads")
    first = F.when(F.col("page_id") > F.col("__first"), F.col("__first"))
    return named.join(repeated, "__body", "left").withColumn("refers_to", first).drop("__body", "__first")


def archive_pages(pages: DataFrame, directory: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives and return their records as read back.

    Null html is an empty payload.  Repeated rows are records of their own; an empty
    table gives no archive and no rows; further columns are ignored.
    """
    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    write_archives(with_revisits(narrow, least_bytes), directory)
    return read_archives(pages.sparkSession, directory)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = archive_pages(pages, shared_path(spark, "warc"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as long)")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to")
    )


#: DuckDB has SHA-1 in hexadecimal only: base 32 is put together from its bits, eight characters for five bytes.
OP1_SQL = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (SELECT hex, min(page_id) AS first_id FROM digests GROUP BY hex),
bits AS (
  SELECT page_id, payload_bytes, d.hex, first_id,
    list_transform(range(0, 8), lambda g: ('0x' || substr(d.hex, g * 5 + 1, 5))::BIGINT) AS twenty
  FROM digests d JOIN firsts USING (hex)
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(flatten(list_transform(twenty, lambda v: list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)))), '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM bits
"""

QUERIES = {"op1_warc": op1_warc}
ORACLE_SQL = {"op1_warc": OP1_SQL}
