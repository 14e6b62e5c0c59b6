"""WARC archives: a writer, and a Python data source that reads headers first.

The source plans byte ranges of files as partitions and takes filters on record type and header columns; a record
that they reject is skipped by its length, its payload undecoded. Each record is a gzip member of its own whose
extra field tells the member's length, so ranges can start anywhere and unwanted members are not inflated. Other
gzip archives and plain ones are read too, one task a file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull

from tarn.llm.common import bounded_batches, hot_keys, salted_join, shared_folder, written

RECORD_URN = "<urn:x-page:{}>"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records with equal payloads of at least so many bytes are stored once.
REVISIT_FROM = 100
RANGE_BYTES = 32 << 20
_FIXED = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00WL\x08\x00"
_HEAD = len(_FIXED) + 8

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, content_type string, payload binary"
#: Columns that come from headers; filters on them are pushed down.
HEADER_COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = _HEAD + len(body) + 8
    return _FIXED + struct.pack("<Q", size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, url: str | None, digest: str, payload: bytes | None, length: int, refers_to: str | None = None) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block += payload or b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(key, url, payload, n, digest, refers_to): of equal payloads of ``revisit_from`` bytes or more the record with the smallest key is kept and others refer to it.

    Null html is an empty payload. Null keys never are referred to while their group has a key; rows that repeat the smallest key are all responses.
    """
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("payload"))
    base = base.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    groups = base.select("key", "n", "digest").where(F.col("n") >= revisit_from).groupBy("digest", "n").agg(F.min("key").alias("keep"), F.count("*").alias("copies")).where("copies > 1 AND keep IS NOT NULL")
    # Written first: its true size is known then, and Spark broadcasts it only below its threshold.
    groups = written(groups, "warc-copies")
    joined = salted_join(base, groups.drop("copies"), ["digest", "n"], ["key"], "left", hot_keys(groups, ["digest", "n"], "copies"))
    again = F.col("keep").isNotNull() & ~F.col("key").eqNullSafe(F.col("keep"))
    return joined.select("key", "url", F.when(~again, F.col("payload")).alias("payload"), "n", "digest", F.when(again, F.col("keep")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per partition below ``folder`` (a uri that pyarrow opens on every executor) and returns the manifest (file, records, bytes).

    A task writes under a name of its own and renames at the end, so a lost or repeated attempt leaves no half archive in place.
    """
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.gz"
        own = f"{base}/.{name}.{task.taskAttemptId()}"
        count = size = 0
        with fs.open_output_stream(own) as out:
            for b in batches:
                for k, url, payload, n, digest, ref in zip(b["key"], b["url"], b["payload"], b["n"], b["digest"], b["refers_to"], strict=True):
                    is_copy = ref is not None
                    data = record("revisit" if is_copy else "response", RECORD_URN.format(k), url, digest, None if is_copy else payload.encode("utf-8", "surrogatepass"), int(n), RECORD_URN.format(ref) if is_copy else None)
                    size += out.write(m := member(data)) or len(m)
                    count += 1
        if count:
            fs.move(own, f"{base}/{name}")
        else:
            fs.delete_file(own)
        yield pd.DataFrame({"file": [name], "records": [count], "bytes": [size]})

    # Keys travel as text, so that a column with nulls keeps whole numbers.
    rows = records.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "url", "payload", "n", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return written(rows.mapInPandas(run, "file string, records long, bytes long"), "warc-manifest")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


@dataclass
class Wanted:
    """What the pushed filters ask of a header: for each column the values allowed, or None for any that is present."""

    allowed: dict[str, list[set | None]] = field(default_factory=dict)

    def take(self, f: Filter) -> bool:
        column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if column not in HEADER_COLUMNS:
            return False
        values = {f.value} if isinstance(f, EqualTo | EqualNullSafe) else set(f.value) if isinstance(f, In) else None
        if values is None and not isinstance(f, IsNotNull) or values is not None and None in values:
            return False
        self.allowed.setdefault(column, []).append(values)
        return True

    def fits(self, row: dict[str, str | None]) -> bool:
        return all(row[c] is not None and (v is None or row[c] in v) for c, vs in self.allowed.items() for v in vs)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder or file uri)``; option ``payload`` = false leaves payloads out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.wanted = Wanted()
        self.skipped = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Range]:
        fs, base = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.File:
            files = [info]
        elif info.type == pafs.FileType.Directory:
            files = [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        else:
            files = []
        out = []
        for f in sorted(files, key=lambda f: f.path):
            out += [Range(f.path, at, min(at + self.range_bytes, f.size)) for at in range(0, f.size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string()) for n in names])
        rows, held = [], 0
        with fs.open_input_file(part.path) as f:
            for row in read_range(f, part.start, part.end, self.wanted, self.payload):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_range(f, start: int, end: int, wanted: Wanted, payload: bool) -> Iterator[dict]:
    """The wanted records that begin in [start, end)."""
    f.seek(0)
    magic = f.read(len(_FIXED))
    if magic == _FIXED:
        yield from _own_members(f, start, end, wanted, payload)
    elif start == 0:
        f.seek(0)
        yield from _stream(f, magic[:2] == b"\x1f\x8b", wanted, payload)


def _next_member(f, at: int, end: int) -> int | None:
    """The first member that begins at ``at`` or behind, below ``end``."""
    step = 1 << 20
    while at < end:
        f.seek(at)
        window = f.read(step + len(_FIXED) + 256)
        found = window.find(_FIXED)
        while 0 <= found < step:
            if at + found >= end:
                return None
            try:
                if zlib.decompressobj(-15).decompress(window[found + _HEAD : found + _HEAD + 200], 5) == b"WARC/":
                    return at + found
            except zlib.error:
                pass
            found = window.find(_FIXED, found + 1)
        at += step
    return None


def _own_members(f, start: int, end: int, wanted: Wanted, payload: bool) -> Iterator[dict]:
    at = start if start == 0 else _next_member(f, start, end)
    while at is not None and at < end:
        f.seek(at)
        first = f.read(_HEAD + 1200)
        if len(first) < _HEAD:
            return
        (size,) = struct.unpack("<Q", first[len(_FIXED) : _HEAD])
        d = zlib.decompressobj(-15)
        head, data, fed = b"", first[_HEAD:], len(first)
        while True:
            head += d.decompress(data, 4096)
            if b"\r\n\r\n" in head or d.eof:
                break
            data = d.unconsumed_tail
            if not data:
                data = f.read(min(4096, size - fed))
                fed += len(data)
                if not data:
                    break
        cut = head.find(b"\r\n\r\n") + 4
        row = header_row(head[:cut])
        if row is not None and wanted.fits(row):
            if payload:
                rest = d.unconsumed_tail + f.read(size - fed) if fed < size else d.unconsumed_tail
                block = head[cut:] + d.decompress(rest) if not d.eof else head[cut:]
                row["payload"] = payload_of(row, block[: row["_length"]])
            row.pop("_length")
            yield row
        at += size


def _stream(f, zipped: bool, wanted: Wanted, payload: bool) -> Iterator[dict]:
    """Any archive from its beginning; blocks that are not wanted are passed over piece by piece."""
    buffer, inflate = bytearray(), zlib.decompressobj(31) if zipped else None

    def more() -> bool:
        nonlocal inflate
        if inflate is None:
            piece = f.read(1 << 18)
            buffer.extend(piece)
            return bool(piece)
        while True:
            raw = inflate.unconsumed_tail or inflate.unused_data or f.read(1 << 16)
            if not raw:
                return False
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            piece = inflate.decompress(raw, 1 << 18)
            if piece:
                buffer.extend(piece)
                return True

    while True:
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        row = header_row(bytes(buffer[: cut + 4]))
        del buffer[: cut + 4]
        if row is None:
            continue
        take, left, kept = wanted.fits(row), row["_length"], []
        while left > 0:
            if not buffer and not more():
                break
            piece = bytes(buffer[:left])
            del buffer[:left]
            left -= len(piece)
            if take and payload:
                kept.append(piece)
        if take:
            if payload:
                row["payload"] = payload_of(row, b"".join(kept))
            row.pop("_length")
            yield row


def header_row(head: bytes) -> dict | None:
    lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    row: dict = {c: fields.get(h) for c, h in HEADER_COLUMNS.items()}
    length = fields.get("x-payload-length")
    return row | {"payload_length": int(length) if length is not None else None, "payload": None, "_length": int(fields.get("content-length", "0"))}


def payload_of(row: dict, block: bytes) -> bytes | None:
    """The payload of a block: what follows the HTTP header, if it has one; a revisit has none."""
    if row["record_type"] == "revisit":
        return None
    if (row["content_type"] or "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Filters on header columns reach the source where the session has ``spark.sql.python.filterPushdown.enabled``, which is set here if it is not set at all."""
    name = "spark.sql.python.filterPushdown.enabled"
    if spark.conf.get(name, "false") != "true":
        spark.conf.set(name, "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def archived_pages(pages: DataFrame, folder: str | None = None, key: str = "page_id") -> DataFrame:
    """Writes ``pages`` as archives and reads them back: (key, payload_bytes, payload_digest, record_type, refers_to, target_uri).

    Responses and revisits are read apart, each with its record type pushed down; of revisits only headers are asked for.
    Null html is an empty payload. Null keys come back null; rows that repeat a key are records of their own. An empty
    table gives no rows. Payloads of any length are one record. Other columns, whatever their names, are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_archives(with_roles(pages, key), folder)
    kind = dict(pages.dtypes)[key]
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':([^:>]*)>$', 1) AS {kind})")
    responses = read_archives(spark, folder).where("record_type = 'response'")
    revisits = read_archives(spark, folder, payload=False).where("record_type = 'revisit'")
    whole = responses.select(number("record_id").alias(key), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"), "target_uri")
    again = revisits.select(number("record_id").alias(key), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "target_uri")
    return whole.unionByName(again)
