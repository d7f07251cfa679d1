"""WARC archives as a Spark data source (``spark.read.format("warc")`` and ``df.write.format("warc")``).

The reader plans one partition per file, small files packed together. Of each record it parses the headers first; predicates
on record type, target, digest and other headers are pushed down and decided on these alone, and the payload of a
record that is not wanted is passed over without inflating or decoding it: gzip members carry their length in the
``sl`` extra field, and plain records say it in Content-Length. Only foreign members without the field are inflated in full.

Each write task makes files of its own; the driver lists those of a job's successful tasks in a manifest of that job, so what a
lost or repeated task left behind is never read. Appending adds a manifest; overwriting takes the earlier ones away
once the new one is written. Paths are any that Arrow's file systems open.
"""

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds

from yomisaku.llm.common import scratch_path

#: How the names of manifests begin; each write job adds one.
MANIFEST = "_manifest"
PARTITION_BYTES = 64 << 20
FILE_BYTES = 64 << 20
_CHUNK = 64 << 10
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = ("record_id string, record_type string, target_uri string, record_date string, payload_digest string,"
               " refers_to string, payload_bytes long, payload binary, headers map<string,string>")
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "record_date", "refers_to", "payload")

#: Columns whose predicates can be decided on the headers alone.
_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "record_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class WarcSource(ds.DataSource):
    """Options: path; payload = full (the default), verify (checked against its digest, not returned) or none."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), [f.name for f in schema.fields], overwrite)


def _manifests(files: fs.FileSystem, root: str) -> list[str]:
    there = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in there if i.type == fs.FileType.File and i.base_name.startswith(MANIFEST))


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class WarcReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path = _uri(options["path"])
        self.payload = options.get("payload", "full")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        kinds = {ds.EqualTo: "eq", ds.In: "in", ds.IsNull: "null", ds.IsNotNull: "some", ds.StringStartsWith: "start"}
        for f in filters:
            kind, column = kinds.get(type(f)), getattr(f, "attribute", ())
            if kind and len(column) == 1 and column[0] in _HEADER:
                self.tests.append((column[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        files, root = _open_fs(self.path)
        if files.get_file_info(root).type == fs.FileType.File:
            found = [("", files.get_file_info(root).size)]
        elif manifests := _manifests(files, root):
            found = []
            for manifest in manifests:
                with files.open_input_stream(manifest) as f:
                    found += [(x["name"], x["bytes"]) for x in json.loads(f.read())]
        else:
            found = [(i.path[len(root) + 1:], i.size) for i in files.get_file_info(fs.FileSelector(root, recursive=True))
                     if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        plan: list[Files] = []
        room = 0
        for name, size in sorted(found):
            if not plan or size > room:
                plan.append(Files([]))
                room = PARTITION_BYTES
            plan[-1].paths.append(f"{self.path}/{name}".rstrip("/"))
            room -= size
        return plan or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            files, name = _open_fs(path)
            with files.open_input_file(name) as f:
                for record in records(f):
                    row = self._row(record)
                    if row is not None:
                        yield row

    def _row(self, record: "Record") -> tuple | None:
        h = record.headers
        shown = {c: h.get(k) for c, k in _HEADER.items()}
        for c in ("record_id", "refers_to"):
            shown[c] = shown[c] and shown[c].strip("<>")
        digest = shown["payload_digest"]
        shown["payload_digest"] = digest and digest.removeprefix("sha1:")
        if not all(_holds(shown[c], kind, value) for c, kind, value in self.tests):
            return None
        http, size, body = record.http, None, None
        if shown["record_type"] == "revisit":
            size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        else:
            size = record.body_bytes
            if self.payload != "none":
                body = record.body()
                if self.payload == "verify" and digest:
                    if _digest(body) != shown["payload_digest"]:
                        raise ValueError(f"the payload of {shown['record_id']} does not have its digest")
                    body = None
        return (shown["record_id"], shown["record_type"], shown["target_uri"], shown["record_date"],
                shown["payload_digest"], shown["refers_to"], size, body, h)


def _holds(shown, kind, value) -> bool:
    if kind == "null":
        return shown is None
    if shown is None:
        return False
    return {"eq": lambda: shown == value, "in": lambda: shown in value, "some": lambda: True,
            "start": lambda: shown.startswith(value)}[kind]()


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records

class _Source:
    """Bytes of one record: plain from the file, or inflated from a gzip member, read only as far as asked for."""

    def __init__(self, file, at: int, gzipped: bool):
        self.file, self.at, self.gzipped = file, at, gzipped
        self.ready, self.ended = b"", False
        self.inflate = zlib.decompressobj(31) if gzipped else None
        file.seek(at)

    def _more(self) -> bool:
        if self.ended:
            return False
        chunk = self.file.read(_CHUNK)
        if not chunk:
            self.ended = True
            return False
        self.at += len(chunk)
        if self.gzipped:
            self.ready += self.inflate.decompress(chunk)
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                self.ended = True
        else:
            self.ready += chunk
        return True

    def head(self) -> bytes | None:
        """The lines up to an empty one, which is taken too; None at the end of the file."""
        while b"\r\n\r\n" not in self.ready:
            if not self._more():
                if self.ready.strip():
                    raise ValueError("a record's header does not end")
                return None
        head, _, self.ready = self.ready.partition(b"\r\n\r\n")
        return head

    def take(self, n: int) -> bytes:
        parts, got = [self.ready], len(self.ready)
        self.ready = b""
        while got < n and self._more():
            parts.append(self.ready)
            got += len(self.ready)
            self.ready = b""
        whole = b"".join(parts)
        if len(whole) < n:
            raise ValueError("a record is cut off")
        self.ready = whole[n:]
        return whole[:n]


def _fields(head: bytes) -> dict[str, str]:
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
    return fields


class Record:
    """One record whose headers are parsed; http headers and body are read when asked for."""

    def __init__(self, source: _Source, headers: dict[str, str]):
        self.source, self.headers = source, headers
        self.left = int(headers.get("content-length", "0"))
        self._http: dict[str, str] | None = None

    @property
    def http(self) -> dict[str, str]:
        if self._http is None:
            self._http = {}
            if self.headers.get("content-type", "").startswith("application/http"):
                head = self.source.head() or b""
                self.left -= len(head) + 4
                self._http = _fields(head)
        return self._http

    @property
    def body_bytes(self) -> int:
        self.http
        return self.left

    def body(self) -> bytes:
        n, self.left = self.body_bytes, 0
        return self.source.take(n)


def records(file) -> Iterator[Record]:
    """The records of an open archive, gzipped by record or plain."""
    at, size = 0, file.size()
    while at < size:
        file.seek(at)
        start = file.read(24)
        if start[:2] == b"\r\n":  # the empty lines after a plain record
            at += 2
            continue
        gzipped = start[:2] == b"\x1f\x8b"
        source = _Source(file, at, gzipped)
        head = source.head()
        if head is None:
            at = source.at
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        record = Record(source, _fields(head))
        plain_end = at + len(head) + 4 + record.left if not gzipped else None
        yield record
        if not gzipped:
            at = plain_end
        elif start[3] & 4 and start[12:14] == b"sl":
            at += struct.unpack("<I", start[16:20])[0]
        else:
            while not source.ended:
                source.ready = b""
                source._more()
            at = source.at


# ---- writing

@dataclass
class Written(ds.WriterCommitMessage):
    files: list[dict]


class WarcWriter(ds.DataSourceArrowWriter):
    """Writes rows of ``WRITE_COLUMNS``; response and revisit records hold an HTTP header, revisits no payload."""

    def __init__(self, options, columns, overwrite=False):
        missing = {*WRITE_COLUMNS} - {*columns}
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        self.path, self.overwrite = _uri(options["path"]), overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open_fs(self.path)
        files.create_dir(root, recursive=True)
        done, out, name, n = [], None, None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in WRITE_COLUMNS]
            for i in range(batch.num_rows):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                raw = record_bytes(*[c[i].as_py() for c in columns])
                raw = member(raw) if self.gzip else raw
                out.write(raw)
                n += len(raw)
                if n >= self.file_bytes:
                    out.close()
                    done.append({"name": name, "bytes": n})
                    out = None
        if out is not None:
            out.close()
            done.append({"name": name, "bytes": n})
        return Written(done)

    def commit(self, messages):
        files, root = _open_fs(self.path)
        files.create_dir(root, recursive=True)
        before = _manifests(files, root)
        with files.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        for manifest in before if self.overwrite else ():
            files.delete_file(manifest)

    def abort(self, messages):
        """What failed tasks wrote is in no manifest."""


def record_bytes(record_id, record_type, target_uri, record_date, refers_to, payload) -> bytes:
    payload = payload or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {record_date}"]
    if target_uri is not None:
        # Blanks and line ends would end the header line.
        head.append("WARC-Target-URI: " + quote(target_uri, safe="".join(map(chr, range(33, 127)))))
    head.append(f"WARC-Payload-Digest: sha1:{_digest(payload)}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` has its own length and that of its content, so that readers can skip it."""
    packer = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    whole = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


# ---- pages

def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def as_records(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records of ``pages`` (page_id, url, html): equal payloads of ``min_bytes`` or more are stored once.

    The page with the smallest id is the response, the others revisit it. A NULL html is an empty payload, a NULL url
    gives no target. Repeated rows of one id are alike: all are responses if that id is the smallest. Pages without id
    revisit the smallest id of their payload, and are responses if there is none; their records have an id made of
    their content. Other columns are dropped.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    firsts = (base.filter(F.length("payload") >= min_bytes).groupBy("sha")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
              .filter("copies > 1 and first is not null").select("sha", "first"))
    joined = base.join(firsts, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    own = F.coalesce(F.concat(F.lit("urn:x-page:"), F.col("page_id").cast("string")),
                     F.concat(F.lit("urn:x-content:"), F.sha1(F.concat_ws(" ", "sha", "url"))))
    return joined.select(
        own.alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(date).alias("record_date"),
        F.when(revisit, F.concat(F.lit("urn:x-page:"), F.col("first").cast("string"))).alias("refers_to"), "payload")


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip", mode: str = "append") -> None:
    """Write ``as_records`` of the pages to ``path``, beside what earlier jobs wrote there or (``overwrite``) in its place.

    Characters of a URL that are not visible ASCII come back percent-encoded.
    """
    register(pages.sparkSession)
    as_records(pages, min_bytes).write.format("warc").option("compression", compression).mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """The records of the archives under ``path``; see ``WarcSource`` for ``payload``."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def page_of(column: str) -> F.Column:
    return F.regexp_extract(column, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes the pages below the shared scratch folder, reads the archives back and lists each record."""
    path = scratch_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    got = read_warc(pages.sparkSession, path, "verify")
    return got.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      page_of("refers_to").alias("refers_to"))
