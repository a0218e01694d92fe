"""WARC archives as a PySpark Python data source, format name ``warc``.

Writing: each row becomes a WARC/1.1 record in a gzip member of its own. The
member's header names its own length (an extra field, RFC 1952 section 2.3.1.1),
so a reader can step over a record without inflating it; other readers ignore
the field. Files of tasks that failed or ran twice are never read: the commit
writes a manifest of the files that count, with the places where they may be
split.

Reading: the manifest's splits (or, in a folder without one, whole files) are the
partitions. Of a record, the headers are inflated and parsed first. Predicates on
record_type, target_uri, record_id, refers_to and payload_digest are pushed down
(``spark.sql.python.filterPushdown.enabled``) and decided on the headers; a
payload is inflated only if its record passes and the ``payload`` option asks for
it: ``none`` (headers only), ``digest`` (length and SHA-1 of the bytes read) or
``bytes``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import Scratch, set_unless_set, shared_dir, table

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, http_length long, payload_length long, payload_sha1 string, payload binary"
#: Columns that writing takes; payload_digest and refers_to may be null.
WRITTEN = ["record_id", "record_type", "target_uri", "warc_date", "payload", "payload_digest", "payload_length", "refers_to"]
PUSHED = {"record_type", "target_uri", "record_id", "refers_to", "payload_digest"}
SPLIT_BYTES = 32 << 20
FILE_BYTES = 1 << 30


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _line(text: str) -> str:
    """A header value: line ends and per cent signs are percent-encoded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if text and any(c in text for c in "%\r\n") else text


def _unline(text: str) -> str:
    return text.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if "%" in text else text


def member(record: bytes) -> bytes:
    """A gzip member whose extra field has the member's own length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"PL" + struct.pack("<HQ", 8, size)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the HTTP headers only."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {row['warc_date'] or '1970-01-01T00:00:00Z'}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    if row["payload_digest"]:
        head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row["refers_to"] is not None:
            head.append(f"WARC-Refers-To: <{row['refers_to']}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):  # option names come in lower case
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files, out, at, splits = [], None, 0, []
        name = ""

        def close():
            if out is not None:
                out.close()
                files.append([name, at, splits])

        for batch in iterator:
            for row in batch.select(WRITTEN).to_pylist():
                if out is None or at >= self.file_bytes:
                    close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, at, splits = store.open_output_stream(f"{root}/{name}", compression=None), 0, [0]
                if at - splits[-1] >= self.split_bytes:
                    splits.append(at)
                data = member(record_bytes(row))
                out.write(data)
                at += len(data)
        close()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite:
            files = read_manifest(store, root) + files
        with store.open_output_stream(f"{root}/_manifest.json", compression=None) as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name, *_ in m.files if m is not None else []:
                store.delete_file(f"{root}/{name}")


def read_manifest(store, root: str) -> list:
    try:
        with store.open_input_stream(f"{root}/_manifest.json", compression=None) as f:
            return json.loads(f.read())["files"]
    except FileNotFoundError:
        return []


@dataclass
class Split(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


class Inflated:
    """What the gzip members from a place of a file on hold, one after the other: a member may have a record, many, or a part of one."""

    def __init__(self, f, at: int):
        f.seek(at)
        self.f, self.inflater, self.feed, self.held = f, None, b"", b""

    def _more(self) -> bytes:
        while True:
            if not self.feed:
                self.feed = self.f.read(1 << 16)
            if self.inflater is None:
                if not self.feed.strip(b"\0"):  # the end, or padding behind a member
                    if not self.feed:
                        return b""
                    self.feed = b""
                    continue
                self.inflater = zlib.decompressobj(31)
            elif not self.feed:
                raise ValueError("an archive ends in a gzip member")
            out = self.inflater.decompress(self.feed, 1 << 16)
            self.feed = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.feed, self.inflater = self.inflater.unused_data, None
            if out:
                return out

    def head(self) -> bytes | None:
        """Bytes up to the next empty line; None at the end."""
        held = self.held.lstrip(b"\r\n")
        while (cut := held.find(b"\r\n\r\n")) < 0:
            more = self._more()
            if not more:
                if held.strip():
                    raise ValueError("an archive ends in a record's headers")
                return None
            held = (held + more).lstrip(b"\r\n")
        self.held = held[cut + 4 :]
        return held[:cut]

    def take(self, n: int, keep: bool = True) -> bytes:
        parts, left = [], n
        while left:
            if not self.held:
                self.held = self._more()
                if not self.held:
                    raise ValueError("an archive ends in a record's block")
            part, self.held = self.held[:left], self.held[left:]
            left -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


def _length(headers: dict[str, str]) -> int:
    if not headers.get("content-length", "").isdigit():
        raise ValueError("a record without a Content-Length")
    return int(headers["content-length"])


def _streamed(source: Inflated, wanted):
    while (head := source.head()) is not None:
        headers = _headers(head)
        length = _length(headers)
        read = 0

        def block(limit=None, length=length):
            nonlocal read
            read = length if limit is None else min(limit, length)
            return source.take(read)

        if wanted(headers):
            yield headers, block
        source.take(length - read, keep=False)


def records(f, start: int, end: int, wanted, packed: bool):
    """(headers, function that reads the block) of the records that ``wanted(headers)`` accepts.

    Headers come first; of a record that isn't wanted, or whose block isn't asked
    for, the rest is stepped over: by its length where the gzip member names it,
    else by inflating on. From the first member that names no length, a packed
    file is read as one stream to its end, so that members of many records, as of
    an archive that was packed as a whole, lose none. A file that ends within a
    record, or holds anything else, is an error.
    """
    at = start
    while at < end:
        f.seek(at)
        first = f.read(4096)
        if not first:
            return
        if packed:
            if first[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {at}")
            if first[3] != 4 or first[12:14] != b"PL":
                yield from _streamed(Inflated(f, at), wanted)
                return
            size, body = struct.unpack("<Q", first[16:24])[0], 12 + struct.unpack("<H", first[10:12])[0]
            inflater = zlib.decompressobj(-15)
            feed, head = first[body:], b""
            while b"\r\n\r\n" not in head:
                head += inflater.decompress(feed, 4096)
                feed = inflater.unconsumed_tail
                if b"\r\n\r\n" not in head and not feed:
                    feed = f.read(65536)
                    if not feed:
                        raise ValueError(f"a record at byte {at} ends in its headers")
            text, _, rest = head.partition(b"\r\n\r\n")
            headers = _headers(text)

            def block(limit=None, inflater=inflater, feed=feed, rest=rest, length=_length(headers)):
                goal = length if limit is None else min(limit, length)
                parts, have = [rest], len(rest)
                while have < goal:
                    feed = feed or f.read(1 << 16)
                    if not feed:
                        raise ValueError("a record ends in its block")
                    parts.append(inflater.decompress(feed, min(1 << 16, goal - have)))
                    feed = inflater.unconsumed_tail
                    have += len(parts[-1])
                return b"".join(parts)[:goal]

            if wanted(headers):
                yield headers, block
            at += size
        else:
            text = first
            while b"\r\n\r\n" not in text.lstrip(b"\r\n") and (more := f.read(65536)):
                text += more
            gap = len(text) - len(text.lstrip(b"\r\n"))
            if not text[gap:].strip():
                return
            cut = text.find(b"\r\n\r\n", gap)
            if cut < 0:
                raise ValueError(f"a record at byte {at} ends in its headers")
            headers = _headers(text[gap:cut])
            length, begin = _length(headers), at + cut + 4

            def block(limit=None, begin=begin, length=length):
                f.seek(begin)
                return f.read(length if limit is None else min(limit, length))

            if wanted(headers):
                yield headers, block
            at = begin + length


def _digest(value: str | None) -> str | None:
    """Lower-case hex of a labelled digest in base 32 or base 16."""
    if not value:
        return None
    value = value.rpartition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


_bare = lambda v: None if v is None else v.removeprefix("<").removesuffix(">")


def fields(headers: dict[str, str]) -> dict:
    uri = headers.get("warc-target-uri")
    return {
        "record_id": _bare(headers.get("warc-record-id")),
        "record_type": headers.get("warc-type"),
        "target_uri": None if uri is None else _unline(uri),
        "warc_date": headers.get("warc-date"),
        "payload_digest": _digest(headers.get("warc-payload-digest")),
        "refers_to": _bare(headers.get("warc-refers-to")),
    }


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "none")
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, EqualTo | In) and len(x.attribute) == 1 and x.attribute[0] in PUSHED:
                self.tests.append((x.attribute[0], tuple(x.value) if isinstance(x, In) else (x.value,)))
            elif not isinstance(x, IsNotNull) or x.attribute[0] not in {"record_type", "record_id"}:
                yield x

    def partitions(self):
        store, root = _store(self.path)
        prefix = self.path.removesuffix(root)
        files = read_manifest(store, root)
        if not files:
            from pyarrow import fs

            info = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            files = [[x.path.removeprefix(root + "/"), x.size, [0]] for x in info if x.path.endswith((".warc", ".warc.gz"))]
        return [Split(f"{prefix}{root}/{name}", a, b) for name, size, splits in files for a, b in zip(splits, [*splits[1:], size], strict=True)]

    def read(self, partition):
        if partition is None:
            return
        store, path = _store(partition.file)
        kept = None

        def wanted(headers):
            nonlocal kept
            kept = fields(headers)
            return all(kept[c] in values for c, values in self.tests)

        rows, size = [], 0
        with store.open_input_file(path) as f:
            for headers, block in records(f, partition.start, partition.end, wanted, path.endswith(".gz")):
                row = kept | {"http_length": None, "payload_length": None, "payload_sha1": None, "payload": None}
                if self.payload == "none" or row["record_type"] == "revisit":
                    head = block(limit=8192)
                    http = "http" in headers.get("content-type", "")
                else:
                    head = block()
                    http = "http" in headers.get("content-type", "")
                    body = head.partition(b"\r\n\r\n")[2] if http else head
                    row |= {"payload_length": len(body), "payload_sha1": hashlib.sha1(body).hexdigest()}
                    if self.payload == "bytes":
                        row["payload"] = body
                        size += len(body)
                if http:
                    for x in head.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
                        k, _, v = x.partition(b":")
                        if k.strip().lower() == b"content-length" and v.strip().isdigit():
                            row["http_length"] = int(v)
                rows.append(row)
                if len(rows) >= 4096 or size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


_TYPES = {"http_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _TYPES.get(c, pa.string())) for c in _NAMES], _NAMES)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def write_warc(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(WarcSource)
    df.select(WRITTEN).write.format("warc").mode(mode).option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: str = "none") -> DataFrame:
    """Records of the archives in a folder. payload: none, digest or bytes (see the module)."""
    spark.dataSource.register(WarcSource)
    set_unless_set(spark, "spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(path)


def deduplicated_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Rows for write_warc() from pages (page_id, url, html).

    Of pages with equal payloads of at least ``least_bytes``, that with the
    largest page_id is a response (each row, if it is there more than once), the
    others are revisits that refer to it; all smaller ones are responses. A null
    html is an empty payload. A null page_id never is the one referred to; pages
    whose equals all have none are responses. Digests are grouped with map-side
    combining; groups of two or more are written, so that Spark knows their size
    and shuffles the payloads only where they are too many to broadcast.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    groups = p.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and first is not null").drop("copies")
    joined = p.join(Scratch(pages.sparkSession).save(groups, "digests"), "digest", "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        name("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.col("digest").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(revisit, name("first")).alias("refers_to"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record per page and reads the archives back: bytes of responses, headers of revisits."""
    path = f"{shared_dir(spark)}/polycell-warc-{uuid.uuid4().hex}"
    write_warc(deduplicated_records(table(spark, sf_dir, "pages")), path)
    r = read_warc(spark, path, payload="digest")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return r.filter(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"),
        F.coalesce("payload_length", "http_length").alias("payload_bytes"),
        F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


SQL = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
}
QUERIES = {"op1_warc": op1_warc}
