"""WARC archives: a Python data source that reads and writes them, and revisit records for repeated payloads.

Reading plans partitions of whole files, takes conditions on the record type and
other headers from the query, inflates the head of each record first, and skips
payloads that the conditions or the requested columns leave out: each record is a
gzip member whose extra field tells its length, so the rest of an unwanted one is
never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from ..sources.tables import work_folder
from .common import column

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
LEAST_REVISIT = 100
FILE_BYTES = 64 << 20
# Columns of the source and the headers they come from (fixed names of the format).
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "WARC-Payload-Length",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
HEADER_SCHEMA = ", ".join(f"{c} string" for c in HEADERS)
_END = b"\r\n\r\n"
# Head of a gzip member with an extra field "sl": member length, 4 bytes.
_MEMBER = struct.Struct("<4sIBBHBBHI")


@dataclass
class FilePartition(InputPartition):
    files: list[str]


class WarcSource(DataSource):
    """`spark.read.format("warc").load(folder)`; ask for HEADER_SCHEMA to leave all payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> "WarcReader":
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> "WarcWriter":
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.columns = path, schema.fieldNames()
        unknown = set(self.columns) - set(HEADERS) - {"payload"}
        if unknown:
            raise ValueError(f"no such columns in a WARC record: {sorted(unknown)}")
        self.arrow = pa.schema([(c, pa.binary() if c == "payload" else pa.string()) for c in self.columns])
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and (
                    len(f.attribute) == 1 and f.attribute[0] in HEADERS):
                self.conditions.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Whole files, small ones together."""
        system, root = fs.FileSystem.from_uri(self.path)
        files = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        out: list[FilePartition] = []
        room = 0
        for info in sorted((f for f in files if f.is_file and f.base_name.endswith(".warc.gz")), key=lambda f: f.path):
            if not out or room < info.size:
                out.append(FilePartition([]))
                room = FILE_BYTES
            out[-1].files.append(info.path)
            room -= info.size
        return out or [FilePartition([])]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.files:
            with system.open_input_file(path) as file:
                for row in self._records(file):
                    rows.append(row)
                    held += sum(len(x) for x in row if x is not None)
                    if held > 8 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        parts = list(zip(*rows)) or [()] * len(self.columns)
        return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, self.arrow)], schema=self.arrow)

    def _records(self, file) -> Iterator[tuple]:
        at, size = 0, file.size()
        while at < size:
            file.seek(at)
            chunk = file.read(2048)
            length = member_length(chunk)
            inflate = zlib.decompressobj(31)
            head = inflate.decompress(chunk, 4096)
            while _END not in head:
                if not (more := inflate.unconsumed_tail or file.read(4096)):
                    raise ValueError(f"a record at byte {at} has no end of its headers")
                head += inflate.decompress(more, 4096)
            block = head.index(_END) + len(_END)
            headers = parsed_headers(head[:block])
            wanted = all(_holds(f, headers.get(HEADERS[f.attribute[0]].lower())) for f in self.conditions)
            if not (wanted and "payload" in self.columns) and length:
                at += length
            else:
                parts = [head]
                while not inflate.eof:
                    parts.append(inflate.decompress(inflate.unconsumed_tail or file.read(1 << 20)))
                at = file.tell() - len(inflate.unused_data)
            if wanted:
                row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                if "payload" in self.columns:
                    content = b"".join(parts)[block:block + int(headers["content-length"])]
                    row["payload"] = content.partition(_END)[2] if headers.get("content-type", "").startswith("application/http") else content
                yield tuple(row[c] for c in self.columns)


def _holds(condition: Filter, value: str | None) -> bool:
    if isinstance(condition, EqualNullSafe):
        return value == condition.value
    if value is None:
        return False
    if isinstance(condition, EqualTo):
        return value == condition.value
    if isinstance(condition, In):
        return value in condition.value
    if isinstance(condition, StringStartsWith):
        return value.startswith(condition.value)
    if isinstance(condition, StringEndsWith):
        return value.endswith(condition.value)
    return not isinstance(condition, StringContains) or condition.value in value


def parsed_headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, without the version line."""
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:] if b":" in line)
    return {name.strip().lower().decode(): value.strip().decode() for name, _, value in pairs}


def member_length(head: bytes) -> int:
    """Length that a gzip member states in its extra field; 0 if it states none."""
    if len(head) < _MEMBER.size or head[:2] != b"\x1f\x8b":
        raise ValueError("not a gzip member")
    magic, _, _, _, extra, a, b, n, length = _MEMBER.unpack_from(head)
    return length if magic[3] & 4 and extra >= 8 and (a, b, n) == (0x73, 0x6C, 4) else 0


def member(data: bytes) -> bytes:
    """One gzip member that states its length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 4, 255, 8, 0x73, 0x6C, 4, length) + body + struct.pack(
        "<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], payload: bytes | None) -> bytes:
    """A response record, or a revisit record for payload None: the same headers, no payload."""
    length = fields["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    content = http + (payload or b"")
    lines = ["WARC/1.1"]
    for name, header in HEADERS.items():
        if (value := fields.get(name)) is not None:
            # Control characters would end a header line.
            lines.append(f"{header}: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value))
    lines.append(f"Content-Length: {len(content)}")
    return member("\r\n".join(lines).encode() + _END + content + _END)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with the columns of SCHEMA; files of failed or repeated tasks never become visible."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/_temporary")
        names: list[str] = []
        out, room = None, 0
        for batch in iterator:
            table = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                if room <= 0:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, room = system.open_output_stream(f"{root}/_temporary/{names[-1]}", compression=None), self.file_bytes
                fields = {c: table[c][i].as_py() for c in HEADERS}
                payload = table["payload"][i].as_py() or b""
                data = record(fields, None if fields["record_type"] == "revisit" else payload)
                out.write(data)
                room -= len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.files if message else ():
                system.move(f"{root}/_temporary/{name}", f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.files if message else ():
                system.delete_file(f"{root}/_temporary/{name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set(PUSHDOWN, "true")


def page_records(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url",
                 date: str = "1970-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """One record per page, with the columns of SCHEMA.

    Of pages with equal payloads of at least `least` bytes the one with the
    smallest key is a response and the others revisit it; pages with a null key, and
    repeated rows of that smallest key, are responses as well. Null html is an
    empty payload; a null key or url leaves its header out.
    """
    rows = pages.select(column(key).cast("bigint").alias("key"), column(url).cast("string").alias("url"),
                        F.encode(F.coalesce(column(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload")})
    repeated = rows.where(F.col("length") >= least).groupBy("digest").agg(
        F.min("key").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "first")
    joined = rows.join(repeated, "digest", "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.coalesce(F.col("key") != F.col("first"), F.lit(False))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(name(F.col("key")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("length").cast("string").alias("payload_length"),
        F.lit("application/http;msgtype=response").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_archive(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(SCHEMA if payloads else HEADER_SCHEMA).load(path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes an archive of all pages to the work folder and reads it back: page_id, payload_bytes, payload_digest,
    record_type and refers_to per record.

    Responses are measured by their payloads as read, which must have the digest
    their header states; revisits by their headers, with no payload decoded.
    """
    spark = pages.sparkSession
    folder = f"{work_folder(spark)}/archive-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    write_archive(page_records(pages), folder)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    stated = F.substring_index("payload_digest", ":", -1)
    found = F.sha2("payload", 256)
    responses = read_archive(spark, folder).where(F.col("record_type") == "response").select(
        "record_id", "record_type", "refers_to", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(found == stated, found).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"))
    revisits = read_archive(spark, folder, payloads=False).where(F.col("record_type") == "revisit").select(
        "record_id", "record_type", "refers_to", F.col("payload_length").cast("bigint").alias("payload_bytes"),
        stated.alias("payload_digest"))
    return responses.unionByName(revisits).select(
        F.nullif(number("record_id"), F.lit("")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.nullif(number("refers_to"), F.lit("")).cast("bigint").alias("refers_to"))
