"""WARC archives as a PySpark data source (operator 2): format "warc".

Reading: partitions are planned from the files (a manifest of the writer also
gives offsets at which large uncompressed files are split; other folders are
read file by file, .warc and .warc.gz).  Equality and IN predicates on
record_type, record_id, target_uri, refers_to and payload_digest are pushed
down: a record's headers are parsed first, and the block of an unwanted record
is skipped (by seek where the file is not compressed), its payload neither cut
out nor decoded nor checked.  Option payload=false skips all blocks.

Writing: each task writes a file of its own; a job's manifest, written on commit,
names the files that count, so what failed or repeated attempts leave behind is
not read.  An append adds a manifest, and readers take the files of all; an
overwrite takes away the manifests before it, then their files.  A response record holds an HTTP response with the payload; a revisit
record holds its headers alone and refers to the record with the same payload.
Every record carries the SHA-1 of its payload in base 32 and its length.

Cases: null payload: empty.  Null url: empty WARC-Target-URI.  Control
characters in urls: percent-encoded.  Null page_id: the record id ends in
"null"; such a page is a revisit if a page with an id has the same payload, else
a response.  Rows that repeat page_id and payload: all alike.  Rows that repeat
page_id with other payloads: record ids hold the payload's SHA-1 too, so they differ
and a reference names one payload.  Very long payloads: whole, a record is held in
memory by one task.  Empty table: an archive without files, an empty result.  A record that breaks off or does not
begin with WARC/: an error that names file and offset.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from wattline.llm.common import materialize, scratch_path

SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_bytes long, digest_ok boolean, payload binary")
#: Column -> header that a predicate on it is checked against.
HEADER_OF = {"record_type": b"warc-type", "record_id": b"warc-record-id", "target_uri": b"warc-target-uri", "refers_to": b"warc-refers-to", "payload_digest": b"warc-payload-digest"}
MANIFEST = "_manifest"


def digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- files


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _open(uri: str) -> io.BufferedReader:
    f, path = _fs(uri)
    return io.BufferedReader(f.open_input_file(path), 1 << 20)


def manifests(f, path: str) -> list[str]:
    """Paths of the manifests in a folder, one for each job that wrote there."""
    from pyarrow import fs

    found = f.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(i.path for i in found if i.type == fs.FileType.File and i.base_name.startswith(MANIFEST))


def files_of(f, manifest: str) -> list[dict]:
    with f.open_input_stream(manifest) as s:
        return json.loads(s.read())


# ---------------------------------------------------------------- reading


def _value(header: bytes, raw: bytes | None) -> str | None:
    """A header's value as its column shows it: ids without brackets, digests without the algorithm."""
    if raw is None:
        return None
    text = raw.decode("utf-8", "replace")
    if header in (b"warc-record-id", b"warc-refers-to"):
        return text.strip("<>")
    return text.rpartition(":")[2] if header == b"warc-payload-digest" else text


def _headers(f: io.BufferedReader) -> dict[bytes, bytes] | None:
    """Headers of the record that begins here; None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    out: dict[bytes, bytes] = {}
    name = b""
    while (line := f.readline()) not in (b"\r\n", b"\n"):
        if not line.endswith(b"\n"):
            raise ValueError("the headers break off")
        if line[:1] in b" \t" and name:  # a continued line
            out[name] += b" " + line.strip()
            continue
        name, _, value = line.partition(b":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _skip(f: io.BufferedReader, n: int, seekable: bool) -> None:
    if seekable:
        f.seek(n, io.SEEK_CUR)
        return
    while n:
        got = f.read(min(n, 1 << 16))
        if not got:
            raise ValueError("the block breaks off")
        n -= len(got)


def _body(block: bytes, headers: dict[bytes, bytes]) -> bytes:
    """The payload of a block: an HTTP message's body, or the block itself."""
    if headers.get(b"content-type", b"").startswith(b"application/http"):
        _, found, body = block.partition(b"\r\n\r\n")
        return body if found else b""
    return block


@dataclass
class Span(InputPartition):
    """Part of a file: records that begin in [start, end)."""

    uri: str
    start: int
    end: int

    def __init__(self, uri: str, start: int, end: int):
        super().__init__(uri)
        self.uri, self.start, self.end = uri, start, end


def records(span: Span, wanted: dict[bytes, set], with_payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA of the records that have a wanted value in each header of `wanted`."""
    with _open(span.uri) as raw:
        packed = span.uri.endswith(".gz")
        f = gzip.GzipFile(fileobj=raw) if packed else raw
        f = io.BufferedReader(f, 1 << 16) if packed else f
        if span.start:
            f.seek(span.start)
        while True:
            while f.peek(1)[:1] in (b"\r", b"\n"):  # blank lines between records
                f.read(1)
            at = 0 if packed else f.tell()
            if not packed and at >= span.end:
                return
            try:
                h = _headers(f)
                if h is None:
                    return
                size = int(h[b"content-length"])
                if any(_value(k, h.get(k)) not in values for k, values in wanted.items()):
                    _skip(f, size, not packed)
                    continue
                kind = _value(b"warc-type", h.get(b"warc-type"))
                payload, ok = None, None
                told = h.get(b"x-payload-length")
                length = int(told) if told else None
                stamp = _value(b"warc-payload-digest", h.get(b"warc-payload-digest"))
                if with_payload and kind != "revisit":
                    block = f.read(size)
                    if len(block) < size:
                        raise ValueError("the block breaks off")
                    payload = _body(block, h)
                    length, ok = len(payload), None if stamp is None else digest(payload) == stamp
                else:
                    _skip(f, size, not packed)
            except (ValueError, KeyError, EOFError) as e:
                raise ValueError(f"{span.uri}, record at {at}: {e}") from e
            yield (_value(b"warc-record-id", h.get(b"warc-record-id")), kind, _value(b"", h.get(b"warc-target-uri")), _value(b"", h.get(b"warc-date")),
                   _value(b"warc-refers-to", h.get(b"warc-refers-to")), stamp, length, ok, payload)


_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])


class WarcReader(DataSourceReader):
    """Plans spans of files; wanted: header -> values, from pushed predicates."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.wanted: dict[bytes, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            header = HEADER_OF.get(column)
            if header and isinstance(f, (EqualTo, EqualNullSafe)):
                values = {f.value}
            elif header and isinstance(f, In):
                values = set(f.value)
            else:
                yield f
                continue
            self.wanted[header] = values & self.wanted.get(header, values)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        f, path = _fs(self.path)
        base = self.path if path != self.path.rstrip("/") or "://" in self.path else path
        info = f.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Span(self.path, 0, info.size)]
        out: list[InputPartition] = []
        if listed := manifests(f, path):
            for one in (x for m in listed for x in files_of(f, m)):
                marks = [0, *one["splits"], one["size"]]
                out += [Span(f"{base}/{one['name']}", a, b) for a, b in zip(marks, marks[1:])]
            return out or [Span("", 0, 0)]
        for one in sorted(f.get_file_info(fs.FileSelector(path)), key=lambda i: i.base_name):
            if one.type == fs.FileType.File and one.base_name.endswith((".warc", ".warc.gz")):
                out.append(Span(f"{base}/{one.base_name}", 0, one.size))
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        rows, size = [], 0
        for r in records(partition, self.wanted, self.with_payload):
            rows.append(r)
            size += len(r[-1] or b"") + 200
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


# ---------------------------------------------------------------- writing


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record in WARC 1.1."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def _clean_uri(uri: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri or "")


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, payload, refers_to (by name)."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.packed = str(options.get("compression", "none")).lower() == "gzip"
        self.split = int(options.get("splitbytes", options.get("splitBytes", 32 << 20)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed
        size, splits, out = 0, [], None
        for batch in iterator:
            cols = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("record_id", "record_type", "target_uri", "payload", "refers_to")}
            for rid, kind, uri, payload, refers in zip(*cols.values()):
                if out is None:
                    f, path = _fs(self.path)
                    f.create_dir(path, recursive=True)
                    out = f.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)
                data = record(kind, rid, _clean_uri(uri), self.date, payload or b"", refers)
                if self.packed:
                    data = gzip.compress(data, 6, mtime=0)
                elif size - (splits[-1] if splits else 0) >= self.split:
                    splits.append(size)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(name if out is not None else "", size, splits)

    def commit(self, messages: list) -> None:
        f, path = _fs(self.path)
        f.create_dir(path, recursive=True)
        files = [{"name": m.name, "size": m.size, "splits": m.splits} for m in messages if m is not None and m.name]
        before = manifests(f, path) if self.overwrite else []
        with f.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        gone = [x["name"] for m in before for x in files_of(f, m)]
        for name in [*before, *[f"{path}/{n}" for n in gone]]:  # the manifests first: a reader never meets one without its files
            f.delete_file(name)

    def abort(self, messages: list) -> None:
        f, path = _fs(self.path)
        for m in messages:
            if m is not None and m.name:
                f.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages to archives and back


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of pages (page_id, url, html): of those with equal payloads of at least least_bytes the one
    with the largest page_id is the response, the others revisit it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("key", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload").cast("string")))
    # a row for each payload that occurs more than once; the sum is by map-side combine
    again = (rows.filter(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and best is not null").select("key", "best"))
    both = rows.join(materialize(again, "warc-payloads"), "key", "left")
    name = lambda page: F.concat(F.lit("urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.substring("key", 1, 40))
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return both.select(name(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload",
                       F.when(revisit, name(F.col("best"))).alias("refers_to"))


def write(records_: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    register(records_.sparkSession)
    records_.write.format("warc").mode(mode).options(**options).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def page_of(record_id):
    """The page_id in a record id."""
    return F.regexp_extract(record_id, r"^urn:x-page:(-?\d+)(?::|$)", 1).try_cast("long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, digest_ok (the payload read has the digest of its header)."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(page_records(pages), path)
    back = read(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    return back.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"), "digest_ok")
