"""WARC archives as a Spark data source (format ``askloom_warc``).

Reading plans partitions of whole files by size. Filters on header columns are pushed into the
reader: each record's headers are parsed first, and a record that a filter rejects, or whose
payload no column asks for, is passed over without decoding its payload. The writer notes the
length of each gzip member in the ``sl`` extra field, so such a record is not even inflated;
archives without the field are inflated and discarded. A task holds one payload and one batch.

Writing gives a gzip member per record and starts a new file at ``max_file_bytes``. Files count
once the job commits: the manifest names those of the successful attempts, so a task that ran
twice because of a lost executor leaves no duplicate records. Folders without a manifest are
read by listing ``*.warc`` and ``*.warc.gz``.

Defined results: a null payload is empty; a null url writes no target; control characters and
spaces of a url are percent-encoded; records of empty payloads are records. An empty table gives a
folder without archives, which reads as no rows. Columns of other names are not written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from askloom.llm.common import written

FORMAT = "askloom_warc"
MANIFEST = "_manifest.json"
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, content_type string, content_length long, payload_length long, "
    "http_status int, payload binary, file string, offset long"
)
#: Column of each WARC header field that is read.
FIELDS = {
    "warc-record-id": "record_id",
    "warc-type": "record_type",
    "warc-target-uri": "target_uri",
    "warc-date": "date",
    "warc-refers-to": "refers_to",
    "warc-payload-digest": "payload_digest",
    "content-type": "content_type",
    "content-length": "content_length",
}
#: Columns that are known before any payload byte is decoded.
HEADER_COLUMNS = frozenset(FIELDS.values())
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -----------------------------------------------------------------------------------


def member(record: bytes) -> bytes:
    """One gzip member whose ``sl`` extra field holds its compressed and its plain length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + len(tail)
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def quoted(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(row: dict, date: str) -> bytes:
    """A response, or a revisit that has the HTTP head of its response and no payload."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Date", row.get("date") or date),
        ("WARC-Target-URI", quoted(row["target_uri"]) if row.get("target_uri") else None),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Refers-To", f"<{row['refers_to']}>" if row.get("refers_to") else None),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path = options["path"]
        self.max_bytes = int(options.get("max_file_bytes", 1 << 30))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, int]] = []
        attempt, out, size = uuid.uuid4().hex, None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name = f"{attempt}-{len(files):05d}.warc.gz"
                        out, size = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                        files.append((name, 0))
                    data = member(record_bytes(row, self.date))
                    out.write(data)
                    size += len(data)
                    files[-1] = (files[-1][0], size)
                    if size >= self.max_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite:
            files = manifest(store, folder) + files if has_manifest(store, folder) else files
        with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{folder}/{name}")


# --- reading -----------------------------------------------------------------------------------


def has_manifest(store: fs.FileSystem, folder: str) -> bool:
    return store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File


def manifest(store: fs.FileSystem, folder: str) -> list[tuple[str, int]]:
    with store.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as f:
        return [tuple(x) for x in json.loads(f.read())["files"]]


def archives(path: str) -> list[tuple[str, int]]:
    """(path, size) of the archives in a folder, or of one archive."""
    store, folder = filesystem(path)
    info = store.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [(folder, info.size)]
    if has_manifest(store, folder):
        return [(f"{folder}/{name}", size) for name, size in manifest(store, folder)]
    found = store.get_file_info(fs.FileSelector(folder, recursive=True))
    return sorted((f.path, f.size) for f in found if re.search(r"\.warc(\.gz)?$", f.path))


TESTS = {
    EqualTo: lambda have, want: have is not None and have == want,
    EqualNullSafe: lambda have, want: have == want,
    In: lambda have, want: have is not None and have in want,
    GreaterThan: lambda have, want: have is not None and have > want,
    GreaterThanOrEqual: lambda have, want: have is not None and have >= want,
    LessThan: lambda have, want: have is not None and have < want,
    LessThanOrEqual: lambda have, want: have is not None and have <= want,
    StringStartsWith: lambda have, want: have is not None and have.startswith(want),
    StringEndsWith: lambda have, want: have is not None and have.endswith(want),
    StringContains: lambda have, want: have is not None and want in have,
    IsNull: lambda have, want: have is None,
    IsNotNull: lambda have, want: have is not None,
}


class Block:
    """The bytes of one record, taken from an open file as far as they are asked for."""

    def __init__(self, file: io.BufferedReader, start: int, packed: bool) -> None:
        self.file, self.start, self.packed = file, start, packed
        self.data, self.eof = b"", False
        file.seek(start)
        self.unpack = zlib.decompressobj(31) if packed else None
        self.fed = 0

    def more(self) -> bool:
        """Take another chunk; false at the end of the member or file."""
        if self.eof:
            return False
        raw = self.file.read(CHUNK if self.fed else 2048)
        self.fed += len(raw)
        if not raw:
            self.eof = True
            return False
        if self.packed:
            self.data += self.unpack.decompress(raw)
            self.eof = self.unpack.eof
        else:
            self.data += raw
        return True

    def until(self, mark: bytes, at: int = 0) -> int:
        """Offset after the first ``mark`` from ``at`` on; -1 if there is none."""
        while (found := self.data.find(mark, at)) < 0:
            if not self.more():
                return -1
        return found + len(mark)

    def upto(self, size: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < size:  # joined once: payloads may be large
            self.data = b""
            if not self.more():
                break
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        return self.data[:size]

    def member_end(self) -> int:
        """Where the next member starts, by inflating the rest of this one."""
        while not self.unpack.eof:
            raw = self.file.read(CHUNK)
            if not raw:
                return self.start + self.fed
            self.fed += len(raw)
            self.unpack.decompress(raw)
        return self.start + self.fed - len(self.unpack.unused_data)


def noted_length(file: io.BufferedReader, start: int) -> int | None:
    """Length of the gzip member at ``start`` if its ``sl`` extra field tells."""
    file.seek(start)
    head = file.read(12)
    if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return None
    extra = file.read(struct.unpack("<H", head[10:])[0])
    at = 0
    while at + 4 <= len(extra):
        name, size = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
        if name == b"sl" and size == 8:
            return struct.unpack("<I", extra[at + 4 : at + 8])[0] or None
        at += 4 + size
    return None


def header_row(head: bytes) -> dict:
    row: dict = dict.fromkeys(HEADER_COLUMNS)
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        column = FIELDS.get(name.strip().lower())
        if colon and column:
            row[column] = value.strip()
    length = (row["content_length"] or "0").strip()
    # a length that is no number makes the record damaged: it has none
    row["content_length"] = int(length) if re.fullmatch(r"[0-9]{1,18}", length) else None
    for name in ("record_id", "refers_to"):
        if row[name]:
            row[name] = row[name].strip("<>")
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2].upper()
    return row


def http_head(block: bytes) -> tuple[int | None, int | None]:
    status = re.match(rb"HTTP/\S+ (\d{3})", block)
    length = re.search(rb"\ncontent-length:[ \t]*(\d+)", block, re.I)
    return (int(status[1]) if status else None), (int(length[1]) if length else None)


def http_split(record: Block, body: int, end: int) -> int:
    """Where the HTTP head of a block ends, told by the line ends of its first line.

    Without an empty line the block is all payload.
    """
    first = record.until(b"\n", body)
    if first < 0 or first > end:
        return body
    marks = (b"\r\n\r\n", b"\n\n") if record.data[first - 2 : first] == b"\r\n" else (b"\n\n", b"\r\n\r\n")
    for mark in marks:
        if 0 <= (split := record.until(mark, body)) <= end:
            return split
    return body


def next_header(record: Block, at: int) -> int:
    """Where the next record of a plain file begins, after one of unknown length; the file's end if none does."""
    found = record.until(b"\r\n\r\nWARC/", at)
    return len(record.data) if found < 0 else found - len(b"WARC/")


def records(path: str, wanted, payloads: bool, http: bool, verify: bool, store=None) -> Iterator[dict]:
    """Rows of one archive for which ``wanted(header)`` holds."""
    if store is None:
        store, path = filesystem(path)
    packed = path.endswith(".gz")
    with io.BufferedReader(store.open_input_file(path), 1 << 20) as file:
        start, size = 0, file.seek(0, 2)
        while start < size:
            length = noted_length(file, start) if packed else None
            record = Block(file, start, packed)
            if not packed:  # blank lines between records
                while record.data.lstrip(b"\r\n") == b"" and record.more():
                    pass
                blank = len(record.data) - len(record.data.lstrip(b"\r\n"))
                if blank == len(record.data):
                    return
                start += blank
                record = Block(file, start, packed)
            body = record.until(b"\r\n\r\n")
            if body < 0:
                raise ValueError(f"{path}: no WARC header at byte {start}")
            row = header_row(record.data[:body])
            if row["content_length"] is None:  # damaged: the header alone is known
                if wanted(row):
                    yield row | {"offset": start, "file": path}
                if packed:
                    start = start + length if length else record.member_end()
                else:
                    start += next_header(record, body - 4)
                continue
            end = body + row["content_length"]
            if wanted(row):
                row |= {"offset": start, "file": path}
                is_http = (row["content_type"] or "").startswith("application/http")
                if payloads or verify or (http and is_http):
                    split = http_split(record, body, end) if is_http and row["content_length"] else body
                    row["http_status"], told = http_head(record.data[body:split]) if is_http else (None, None)
                    here = end - split
                    row["payload_length"] = told if row["record_type"] == "revisit" else here
                    if (payloads or verify) and row["record_type"] != "revisit":
                        row["payload"] = record.upto(end)[split:]
                        if len(row["payload"]) != here:
                            raise ValueError(f"{path}: record at byte {start} is cut off")
                        if verify and row["payload_digest"] not in (None, base32_sha1(row["payload"])):
                            raise ValueError(f"{path}: payload digest of {row['record_id']} is wrong")
                        if not payloads:
                            row["payload"] = None
                yield row
            if packed:
                start = start + length if length else record.member_end()
            else:
                start += end


@dataclass
class Files(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.path = options["path"]
        self.target = int(options.get("partition_bytes", 128 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind = type(f)
            if kind in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.filters.append((f.attribute[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, length in archives(self.path):
            if out[-1].files and size + length > self.target:
                out.append(Files([]))
                size = 0
            out[-1].files.append(path)
            size += length
        return out

    def wanted(self, row: dict) -> bool:
        return all(TESTS[kind](row[column], value) for column, kind, value in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        names = set(self.schema.names)
        http = bool(names & {"payload_length", "http_status"})
        store, _ = filesystem(self.path)
        rows, size = [], 0
        for path in partition.files:
            for row in records(path, self.wanted, "payload" in names, http, self.verify, store):
                rows.append(row)
                size += len(row.get("payload") or b"")
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Records of all archives under ``path``; name the ``columns`` to leave payloads undecoded."""
    register(spark)
    reader = spark.read.format(FORMAT).options(**options)
    if columns is not None:
        kinds = dict(c.strip().split(" ") for c in SCHEMA.split(","))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def write_archives(rows: DataFrame, path: str, **options) -> None:
    """Write (record_id, record_type, target_uri, refers_to, payload[, date]) as archives."""
    register(rows.sparkSession)
    rows.write.format(FORMAT).options(**options).mode("append").save(path)


# --- pages to archives -------------------------------------------------------------------------


def page_records(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Records of (page_id, url, html): of equal payloads the smallest page_id is the response.

    Payloads are equal if their SHA-256 digests and lengths are. Only digests that occur more than
    once come back to the pages, from a written table, so that a hot payload can be split. A null
    page_id loses against any other; rows that repeat the smallest id are all responses. Payloads
    under ``min_bytes`` are always responses.
    """
    rows = pages.select(
        "page_id",
        F.col("url").cast("string").alias("target_uri"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    digest = F.unhex(F.sha2("payload", 256))
    length = F.octet_length("payload")
    first = written(
        rows.where(length >= min_bytes)
        .groupBy(digest.alias("digest"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1"),
        "payloads",
    ).drop("n")
    name = lambda c: F.concat(F.lit("urn:askloom:page:"), F.col(c).cast("string"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        rows.withColumn("digest", digest)
        .join(first, "digest", "left")
        .select(
            F.coalesce(name("page_id"), F.lit("urn:askloom:page:")).alias("record_id"),
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            "target_uri",
            F.when(revisit, name("first_id")).alias("refers_to"),
            "payload",
        )
    )


def page_number(name: str):
    return F.regexp_extract(name, r"^urn:askloom:page:(-?\d+)$", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``path`` and describe what they hold, digests verified."""
    write_archives(page_records(pages, min_bytes=min_bytes), path)
    columns = ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"]
    return read_archives(pages.sparkSession, path, columns, verify="true").select(
        page_number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page_number("refers_to").alias("refers_to"),
    )
