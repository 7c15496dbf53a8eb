"""WARC archives: a writer, and a Python data source that reads headers first.

Every record is a gzip member of its own, with its compressed length in the member's extra field (SL),
so a reader can step over a payload without reading or decoding it. Files from elsewhere, without that
field or not compressed, are read as well.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from sparkweave.functions.skew import joined

from .common import scratch, stored, tidied
from .places import Values, located

#: Payloads from this size on are archived once.
REVISIT_LEAST = 1000
FILE_BYTES = 256 << 20
#: Column of the data source and the header it is read from.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "payload_length": "x-payload-length",
}
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def member(data: bytes) -> bytes:
    """One gzip member with an SL field: its own length and that of the data."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    length = 12 + 20 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 20) + b"SL" + struct.pack("<HQQ", 16, length, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, name: str, uri: str | None, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if uri is not None:
        fields.append(("WARC-Target-URI", _clean(uri)))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _writer(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        out, path, size, count = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [count], "bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    # a name of its own for each attempt; only files that a finished task names are read
                    path, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{path}", compression=None)
                data = member(record(row["kind"], row["name"], row["uri"], row["digest"], row["size"], row["refers_to"], row["payload"] or b""))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return rows


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", folder: str | None = None) -> list[str]:
    """Write a record per row; the files written.

    A null body is an empty payload. Of the records with equal payloads of at least REVISIT_LEAST bytes
    the one with the largest id is a response and the others revisit it without a payload; rows that share
    that id are all responses, and so are all rows if none of the group has an id. A null id gives the
    name ``urn:page:``, a null url no target. Rows are written where they lie, in any order: only digests
    and ids of payloads from REVISIT_LEAST bytes on are shuffled, no payload is.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    pages, file, row = located(pages)
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    size = F.octet_length(body).cast("long")
    large = stored(pages.where(size >= REVISIT_LEAST).select(F.col(id_col).cast("long").alias("id"), file.alias("file"), row.alias("row"), F.sha1(body).alias("digest")), "warc-digests")
    copies = stored(large.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL"), "warc-copies")
    revisits = joined(large, copies, "digest", "n", large.count()).where("NOT id <=> first").select("file", "row", F.col("first").alias("value"))
    first = Values(spark, "warc-first").write(stored(revisits, "warc-revisits")).of(file, row)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("uri"), body.alias("payload"), first.alias("first"))
    again = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    told = rows.select(
        F.when(again, "revisit").otherwise("response").alias("kind"), name("id").alias("name"), "uri", F.sha1("payload").alias("digest"),
        F.octet_length("payload").cast("long").alias("size"), F.when(again, name("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )
    done = stored(told.mapInArrow(tidied(_writer(folder)), "path string, records long, bytes long"), "warc-manifest")
    return sorted(r.path for r in done.select("path").collect())


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    """One partition a file. Filters on header columns are settled from headers alone."""

    def __init__(self, options: dict):
        if "files" in options:
            self.files = json.loads(options["files"])
        else:
            store, at = _store(options["path"])
            found = store.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
            self.files = sorted(f.path for f in found if f.path.endswith((".warc", ".warc.gz")))
        self.payloads = options.get("payloads", "true").lower() != "false"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if isinstance(f, IsNull):
                fits = value is None
            elif isinstance(f, IsNotNull):
                fits = value is not None
            elif isinstance(f, EqualNullSafe):
                fits = value == f.value
            elif value is None:
                fits = False
            elif isinstance(f, EqualTo):
                fits = value == f.value
            elif isinstance(f, In):
                fits = value in f.value
            else:
                fits = value.startswith(f.value)
            if not fits:
                return False
        return True

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of no files Spark makes one partition
            return
        schema = pa.schema([(n, pa.int64() if n == "payload_length" else pa.string()) for n in HEADERS] + [("payload", pa.binary())])
        rows, size = [], 0
        for row in records(partition.path, self.wanted, self.payloads):
            rows.append(row)
            size += len(row["payload"] or b"")
            if size > 16 << 20 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: path (a folder) or files (a JSON list), payloads (default true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def header_row(head: bytes) -> tuple[dict, int]:
    """The row of a record's header, without its payload, and the length of its block."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}
    row = {column: fields.get(h) for column, h in HEADERS.items()}
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
    return row | {"payload": None}, int(fields.get("content-length", 0))


def _payload(row: dict, block: bytes) -> bytes | None:
    if row["record_type"] == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def records(uri: str, wanted, payloads: bool = True) -> Iterator[dict]:
    """The wanted records of a file, in its order; ``wanted`` sees a row's headers before its payload is touched."""
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        end, at = f.size(), 0
        while at < end:
            f.seek(at)
            start = f.read(min(4096, end - at))
            if start[:2] == b"\x1f\x8b":
                at = yield from _member(f, at, start, wanted, payloads)
            else:
                while b"\r\n\r\n" not in start and f.tell() < end:
                    start += f.read(4096)
                head, _, _ = start.partition(b"\r\n\r\n")
                row, length = header_row(head)
                if wanted(row):
                    if payloads:
                        f.seek(at + len(head) + 4)
                        row["payload"] = _payload(row, f.read(length))
                    yield row
                at += len(head) + 4 + length + 4


def _member(f, at: int, start: bytes, wanted, payloads: bool) -> Iterator[dict]:
    """One gzip member; returns where the next one starts."""
    length = skip = 0
    if start[3] & 4:
        (extra,) = struct.unpack_from("<H", start, 10)
        where = 12
        while where < 12 + extra:
            tag, size = start[where : where + 2], struct.unpack_from("<H", start, where + 2)[0]
            if tag == b"SL":
                length = struct.unpack_from("<Q", start, where + 4)[0]
                skip = 12 + extra if start[3] == 4 else 0
            where += 4 + size
    if not skip:  # from elsewhere: decode the member to find its end
        inflate, data = zlib.decompressobj(31), b""
        data += inflate.decompress(start)
        while not inflate.eof:
            more = f.read(1 << 16)
            if not more:
                raise ValueError("a gzip member ends early")
            data += inflate.decompress(more)
        after = f.tell() - len(inflate.unused_data)
        head, _, rest = data.partition(b"\r\n\r\n")
        row, size = header_row(head)
        if wanted(row):
            yield row | {"payload": _payload(row, rest[:size])} if payloads else row
        return after
    inflate = zlib.decompressobj(-15)
    feed = start[skip : min(len(start), length - 8)]
    data, taken = inflate.decompress(feed, 1024), len(start)
    while b"\r\n\r\n" not in data:
        feed = inflate.unconsumed_tail
        if not feed:
            feed = f.read(min(4096, length - 8 - taken))
            taken += len(feed)
        if not feed:
            raise ValueError("a record has no end of header")
        data += inflate.decompress(feed, 1024)
    head, _, rest = data.partition(b"\r\n\r\n")
    row, size = header_row(head)
    if wanted(row):
        if payloads and row["record_type"] != "revisit":
            f.seek(at)
            whole = f.read(length)
            data = zlib.decompress(whole[skip : length - 8], -15)
            if struct.unpack("<I", whole[-8:-4])[0] != zlib.crc32(data):
                raise ValueError(f"record {row['record_id']} is damaged")
            row["payload"] = _payload(row, data[len(head) + 4 : len(head) + 4 + size])
        yield row
    return at + length


def read(spark: SparkSession, files: list[str], payloads: bool = True) -> DataFrame:
    """The records of these files, by the data source.

    Filters are pushed down in a session of its own that has this switched on; the caller's settings stay.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own.dataSource.register(WarcSource)
    return own.read.format("warc").option("files", json.dumps(files)).option("payloads", str(payloads).lower()).load()


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write the pages and read them back: id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are told from the payload that was read, revisits from their header.
    """
    found = read(pages.sparkSession, write(pages, id_col, url_col, body_col))
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    told = F.regexp_replace("payload_digest", "^sha1:", "")
    digest = F.when(F.col("payload").isNull(), told).when(F.sha1("payload") == told, told).otherwise(F.raise_error(F.concat(F.lit("damaged payload in "), "record_id")).cast("string"))
    return found.select(
        number("record_id").alias(id_col), F.coalesce(F.octet_length("payload"), F.col("payload_length")).cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()
