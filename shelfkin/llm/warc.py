"""WARC archives as a Spark data source: written record by record, read header first.

Writing: each task writes files of its own name and rolls over at ``ROLL_BYTES``; the commit
lists the files of the tasks that succeeded in a manifest, so what a lost executor leaves behind
is never read. A record is a response (HTTP head and gzip-encoded body) or, where an earlier
record has the same payload, a revisit (HTTP head only).

Reading: files of the manifests are packed into partitions by size. Conditions on the record
type and on header fields are pushed into the scan: a record's headers are read first, and the
block of an unwanted record is passed over by a seek, neither read nor decoded. With the option
``payload`` set to ``false`` no block is read at all.

Defined results: a null payload is empty. Line breaks in a URL are percent-encoded; a null URL has
no header. A null page id is written as an id of its own and read as null.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from shelfkin.shipping import ship

ROLL_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"  # the tables have no fetch time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes long, payload binary"
)
# The header fields behind the columns that conditions can be pushed on.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record(kind: str, record_id: str, refers_to: str | None, uri: str | None, digest: str, payload: bytes, size: int) -> bytes:
    """One WARC record."""
    body = gzip.compress(payload, 1, mtime=0) if kind == "response" else b""
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {size}"]
    if kind == "response":
        head += ["Content-Encoding: gzip", f"Content-Length: {len(body)}"]
    block = "\r\n".join(head).encode() + b"\r\n\r\n" + body
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Refers-To": refers_to,
        "WARC-Profile": PROFILE if kind == "revisit" else None, "X-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    clean = {k: v.replace("\r", "%0D").replace("\n", "%0A") for k, v in fields.items() if v is not None}
    lines = "".join(f"{k}: {v}\r\n" for k, v in clean.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[tuple[str, int]] = []
        system, folder = _place(self.folder)
        system.create_dir(folder, recursive=True)
        out, size = None, 0
        for batch in iterator:
            columns = [batch.column(c) for c in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload", "payload_bytes")]
            for values in zip(*columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc"
                    out, size = system.open_output_stream(f"{folder}/{name}"), 0
                data = record(*[v.as_py() for v in values[:5]], values[5].as_py() or b"", values[6].as_py())
                out.write(data)
                size += len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.folder)
        system.create_dir(folder, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that no manifest lists are not read."""


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload = folder, payload
        self.wanted: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column in HEADERS:
                self.wanted.append((HEADERS[column], {f.value}))
            elif isinstance(f, In) and column in HEADERS:
                self.wanted.append((HEADERS[column], set(f.value)))
            elif not (isinstance(f, IsNotNull) and column == "record_type"):
                yield f

    def partitions(self) -> Sequence[Files]:
        system, folder = _place(self.folder)
        listed = system.get_file_info(fs.FileSelector(folder))
        files: list[tuple[str, int]] = []
        for info in sorted(listed, key=lambda i: i.path):
            if info.base_name.startswith("manifest-"):
                with system.open_input_stream(info.path) as f:
                    files += [tuple(x) for x in json.loads(f.read())]
        packs: list[Files] = []
        room = 0
        for name, size in files:
            if size > room:
                packs.append(Files([]))
                room = PARTITION_BYTES
            packs[-1].files.append((name, size))
            room -= size
        return packs or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, folder = _place(self.folder)
        rows: list[tuple] = []
        held = 0
        for name, size in partition.files:
            with system.open_input_file(f"{folder}/{name}") as raw:
                for row in self._records(raw, size):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, raw: pa.NativeFile, size: int) -> Iterator[tuple]:
        at = 0
        while at < size:
            fields, start = _headers(raw, at)
            end = start + int(fields["Content-Length"])
            at = end + 4
            if all(fields.get(h) in values for h, values in self.wanted):
                yield self._row(raw, fields, start, end)

    def _row(self, raw: pa.NativeFile, fields: dict[str, str], start: int, end: int) -> tuple:
        payload, length = None, int(fields["X-Payload-Length"])
        if self.payload and fields["WARC-Type"] == "response":
            raw.seek(start)
            head, _, body = raw.read(end - start).partition(b"\r\n\r\n")
            payload = gzip.decompress(body) if b"Content-Encoding: gzip" in head else body
        return (*[fields.get(h) for h in HEADERS.values()], length, payload)


def _headers(raw: pa.NativeFile, at: int) -> tuple[dict[str, str], int]:
    """The header fields of the record at ``at`` and where its block starts."""
    data, step = b"", 2048
    while (stop := data.find(b"\r\n\r\n")) < 0:
        raw.seek(at + len(data))
        more = raw.read(step)
        if not more:
            raise ValueError(f"record at {at} has no end of headers")
        data, step = data + more, step * 2
    lines = data[:stop].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no record at {at}")
    return dict(line.split(": ", 1) for line in lines[1:]), at + stop + 4


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = [*HEADERS, "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to")
        return WarcWriter(self.options["path"])


def use(spark: SparkSession) -> None:
    """Make the format known to a session and let its conditions reach the scan."""
    ship(spark)
    spark.dataSource.register(Warc)
    spark.conf.set(PUSHDOWN, "true")


def typed_records(pages: DataFrame) -> DataFrame:
    """The record of every row of ``pages(page_id, url, html)``. Of equal payloads of at least
    ``LEAST_REVISIT`` bytes that with the smallest page id is a response, the others revisit it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    long = F.col("payload_bytes") >= LEAST_REVISIT
    first = rows.filter(long).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    joined = rows.join(first, "payload_digest", "left")
    again = long & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"), F.when(again, urn("first")).alias("refers_to"), F.col("url").alias("target_uri"),
        "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, folder: str) -> None:
    """Add records (see ``typed_records``) to the archives of a shared folder."""
    use(records.sparkSession)
    records.write.format("warc").mode("append").option("path", folder).save()


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of a folder's archives."""
    use(spark)
    return spark.read.format("warc").option("path", folder).option("payload", str(payload).lower()).load()


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every page as its
    record tells after writing and reading back: a response's figures come from its decoded
    payload, a revisit's from its headers."""
    spark = pages.sparkSession
    write(typed_records(pages), folder)
    full = read(spark, folder).filter("record_type = 'response'").withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256),
    })
    slim = read(spark, folder, payload=False).filter("record_type = 'revisit'").withColumn(
        "payload_digest", F.regexp_replace("payload_digest", "^sha256:", "")
    )
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return full.unionByName(slim).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
