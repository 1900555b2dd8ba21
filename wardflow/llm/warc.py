"""Web archives: a PySpark data source that writes and reads WARC files.

Writing: each task writes files of about `roll` bytes; the driver's commit lists them, with record offsets to split at, in _files.json,
so that what lost or repeated tasks left behind is never read. Reading: a partition for each listed piece of a file (or, without
a list, for each file). Predicates on the record type and other headers are pushed down; a record's headers are parsed first, and its
block is skipped by a seek if a predicate fails or the schema has no `payload`. Blocks are HTTP responses whose bodies are gzip-coded;
digests are of the decoded body, and a revisit has the HTTP headers alone. Files are opened through pyarrow's file systems.

A very long payload is held whole by the task that writes or reads its record, and by no other. Other columns than SCHEMA's are not written.

Nulls: a null payload is empty; null headers are not written, and read as null. Repeated rows are records each. Empty tables write no file
and read as no rows. A file that is no WARC raises an error that names its place.
"""

from __future__ import annotations

import gzip
import io
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from wardflow.llm.common import fresh_path, lookup, stored, table

LIST, SPLIT, ROLL = "_files.json", 8 << 20, 64 << 20
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Column: header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
DATE = "2024-01-01T00:00:00Z"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri) if not uri.startswith("file:") else fs.FileSystem.from_uri("file://" + uri[5:])


def record(row: dict) -> bytes:
    """A record's bytes; header values lose line breaks."""
    body = row.get("payload") or b""
    whole = row["record_type"] == "response"
    size = row.get("payload_bytes")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\nX-Payload-Length: {len(body) if size is None else size}\r\n\r\n".encode()
    block = http + (zlib.compress(body, 3, 31) if whole else b"")
    head = ["WARC/1.1", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"{h}: {' '.join(str(row[c]).splitlines())}" for c, h in HEADERS.items() if row.get(c) is not None]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, roll: int):
        self.path, self.overwrite, self.roll = path, overwrite, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        disk, root = opened(self.path)
        disk.create_dir(root, recursive=True)
        files, out, at = [], None, 0
        for b in iterator:
            for row in b.to_pylist():
                if out is None or at >= self.roll:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc", 0
                    out = disk.open_output_stream(posixpath.join(root, name))
                    files.append([name, 0, [0]])
                if at >= files[-1][2][-1] + SPLIT:
                    files[-1][2].append(at)
                out.write(raw := record(row))
                at += len(raw)
                files[-1][1] = at
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        disk, root = opened(self.path)
        disk.create_dir(root, recursive=True)
        at = posixpath.join(root, LIST)
        old = []
        if not self.overwrite and disk.get_file_info(at).type != fs.FileType.NotFound:
            old = json.loads(disk.open_input_stream(at).read())
        with disk.open_output_stream(at) as f:
            f.write(json.dumps(old + [x for m in messages if m for x in m.files]).encode())

    def abort(self, messages) -> None:
        disk, root = opened(self.path)
        for m in messages:
            for name, *_ in m.files if m else ():
                disk.delete_file(posixpath.join(root, name))


class _Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int | None):
        self.name, self.start, self.end = name, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], batch: int):
        self.path, self.columns, self.batch = path, columns, batch
        self.equal: dict[str, set] = {}
        self.prefix: dict[str, str] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo) or isinstance(f, In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, values) & values
            elif isinstance(f, IsNotNull):
                self.present.add(name)
            elif isinstance(f, StringStartsWith) and name not in self.prefix:
                self.prefix[name] = f.value
            else:
                yield f

    def partitions(self) -> list[_Piece]:
        disk, root = opened(self.path)
        at = posixpath.join(root, LIST)
        if disk.get_file_info(at).type != fs.FileType.NotFound:
            return [_Piece(name, a, b) for name, size, starts in json.loads(disk.open_input_stream(at).read()) for a, b in zip(starts, [*starts[1:], size])]
        found = disk.get_file_info(fs.FileSelector(root, recursive=False)) if disk.get_file_info(root).type == fs.FileType.Directory else [disk.get_file_info(root)]
        return [_Piece(x.base_name if x.path != root else "", 0, None) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and (".warc" in x.base_name)]

    def wanted(self, head: dict[str, str]) -> bool:
        got = lambda c: head.get(HEADERS[c].lower())
        return all(got(c) in v for c, v in self.equal.items()) and all((got(c) or "").startswith(v) and got(c) is not None for c, v in self.prefix.items()) and all(got(c) is not None for c in self.present)

    def read(self, piece: _Piece | None) -> Iterator[pa.RecordBatch]:
        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in self.columns], self.columns)

        if piece is None:
            return
        disk, root = opened(self.path)
        with disk.open_input_file(posixpath.join(root, piece.name) if piece.name else root) as raw:
            f = gzip.open(raw) if (piece.name or root).endswith(".gz") else io.BufferedReader(raw, 1 << 18)
            f.seek(piece.start)
            while piece.end is None or f.tell() < piece.end:
                row = self._next(f, piece)
                if row is None:
                    break
                if row:
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held >= self.batch:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    def _next(self, f, piece: _Piece) -> dict | None:
        """The next record's columns; {} if it is not wanted, None at the end."""
        at = f.tell()
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at} of {piece.name or self.path}")
        head: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        if not self.wanted(head):
            f.seek(size + 4, 1)
            return {}
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()} | {"payload": None, "payload_bytes": None}
        if not {"payload", "payload_bytes"} & set(self.columns):
            f.seek(size + 4, 1)
            return row
        own = {}
        left = size
        while left > 0 and (line := f.readline(left)):
            left -= len(line)
            if line in (b"\r\n", b"\n"):
                break
            k, _, v = line.decode("utf-8", "replace").partition(":")
            own[k.strip().lower()] = v.strip()
        if "x-payload-length" in own:
            row["payload_bytes"] = int(own["x-payload-length"])
        if "payload" in self.columns and head.get("warc-type") == "response":
            body = f.read(left)
            row["payload"] = zlib.decompress(body, 47) if own.get("content-encoding") == "gzip" else body
            row["payload_bytes"] = len(row["payload"])
            f.seek(4, 1)
        else:
            f.seek(left + 4, 1)
        return row


class WarcSource(DataSource):
    """Options: path; roll (bytes of a file written), batch (bytes of a batch read)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], list(schema.names), int(self.options.get("batch", 4 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("roll", ROLL)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = 100) -> DataFrame:
    """A record for each page: equal payloads of at least `least` bytes after the first (by page_id; every row that has this page_id) are revisits."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", body.alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    by = stored(p.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "equal-pages")
    x = lookup(p, by.select("digest", "first"), "digest", by.select("digest", "n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return x.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    at = fresh_path(spark, "warc")
    records(table(spark, sf_dir, "pages").select("page_id", "url", "html")).write.format("warc").mode("append").save(at)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    read = lambda cols: spark.read.format("warc").schema(cols).load(at)
    whole = read("record_type string, record_id string, payload binary").where("record_type = 'response'")
    whole = whole.select(page(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read("record_type string, record_id string, payload_digest string, refers_to string, payload_bytes long").where("record_type = 'revisit'")
    again = again.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", F.substring("payload_digest", 8, 64).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"))
    return whole.unionByName(again)


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
