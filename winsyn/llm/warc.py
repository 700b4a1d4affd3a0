"""WARC archives: a writer, and a reader that salvages damaged files (op 2).

Archives are ordinary ``.warc.gz`` files, a gzip member for each record, written below a folder that driver and
executors share. An archive's name follows from the task that writes it and is put in place by a rename, so that a task that
runs again replaces its archive by an equal one. Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the
largest id is a response and the others are revisits, which carry its id and no payload.

The reader checks each record: the member's CRC, the version line, the headers, Content-Length and, if there is one, the
block digest. After a failed check it searches for the next gzip magic or version line from which a whole record can be read, goes on
from there, and logs the bytes in between as a quarantined gap. Records of several versions, plain and compressed, may mix.

Null payloads are empty; empty payloads are responses. Rows with one id and one payload are all responses if theirs
is the largest id.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
_NAME = "urn:winsyn:record:"


def _record(kind: str, number: int | None, url: str | None, payload: bytes, size: int, digest: str, refers: int | None) -> bytes:
    heads = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + _NAME.encode() + (b"null" if number is None else b"%d" % number) + b">", b"WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        heads.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    if refers is not None:
        heads += [b"WARC-Refers-To: <" + _NAME.encode() + b"%d" % refers + b">", b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    heads += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"WARC-Block-Digest: sha1:" + hashlib.sha1(payload).hexdigest().encode(), b"X-Payload-Length: %d" % size, b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(heads) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(path: str):
    """(file system, path) for Python; a plain path or any URI that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record for each row; (archive, records, bytes) of each archive, as a table to be evaluated once."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.col(url) if url in df.columns else F.lit(None).cast("string")).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long")).withColumn("digest", F.sha1("body"))
    largest = rows.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(largest, ["digest", "size"], "left")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("first")))
    rows = rows.withColumn("refers", F.when(again, F.col("first"))).withColumn("body", F.when(~again, F.col("body")))

    def write(batches):
        files, root = _filesystem(folder)
        files.create_dir(root)
        part, names, held, count, size = TaskContext.get().partitionId(), [], [], 0, 0

        def close():
            nonlocal held, count, size
            name = f"part-{part:06d}-{len(names):05d}.warc.gz"
            draft = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(draft, compression=None) as f:
                f.write(b"".join(held))
            files.move(draft, f"{root}/{name}")
            names.append((name, count, size))
            held, count, size = [], 0, 0

        for b in batches:
            for number, url_, body, n, digest, refers in zip(*(b.column(c).to_pylist() for c in ("id", "url", "body", "size", "digest", "refers"))):
                data = _gzip(_record("response" if refers is None else "revisit", number, url_, body or b"", n, digest, refers))
                held.append(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.int64()), pa.array([n[2] for n in names], pa.int64())], names=["archive", "records", "bytes"])

    return rows.mapInArrow(write, "archive string, records long, bytes long")


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _plain(data: bytes, at: int, whole: bool = False) -> tuple[dict, bytes, int] | None:
    """The record at ``at``: headers, block and the place behind it; None if a check fails."""
    m = _VERSION.match(data, at)
    stop = data.find(b"\r\n\r\n", at)
    if not m or stop < 0:
        return None
    heads = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        heads[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]+", heads.get("content-length", "")) or "warc-type" not in heads or "warc-record-id" not in heads:
        return None
    end = stop + 4 + int(heads["content-length"])
    block = data[stop + 4 : end]
    if data[end : end + 4] != b"\r\n\r\n" or whole and end + 4 != len(data):
        return None
    told = heads.get("warc-block-digest", "")
    if told.startswith("sha1:") and len(told) == 45 and told[5:].lower() != hashlib.sha1(block).hexdigest():
        return None
    return heads, block, end + 4


def _member(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(memoryview(data)[at:])
    except zlib.error:
        return None
    if not z.eof:
        return None
    got = _plain(out, 0, True)
    return got and (got[0], got[1], len(data) - len(z.unused_data))


def salvage(data: bytes):
    """("record", at, end, headers, block) and ("gap", at, end, None, None), in order, covering all of ``data``."""
    at, bad = 0, None
    while at < len(data):
        got = _plain(data, at) if data[at : at + 5] == b"WARC/" else _member(data, at) if data[at : at + 3] == b"\x1f\x8b\x08" else None
        if got:
            if bad is not None:
                yield "gap", bad, at, None, None
                bad = None
            yield "record", at, got[2], got[0], got[1]
            at = got[2]
        else:
            bad = at if bad is None else bad
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
    if bad is not None:
        yield "gap", bad, len(data), None, None


def read_archives(spark, folder: str) -> DataFrame:
    """Every record and every quarantined gap of the archives below ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")

    def parse(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = []
                for kind, at, end, h, block in salvage(data):
                    h = h or {}
                    rows.append({"archive": os.path.basename(path), "kind": kind, "at": at, "end": end, "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "uri": h.get("warc-target-uri"), "refers": h.get("warc-refers-to"), "told_digest": h.get("warc-payload-digest"), "told_size": h.get("x-payload-length"), "block": block})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    text = pa.string()
    schema = pa.schema([("archive", text), ("kind", text), ("at", pa.int64()), ("end", pa.int64()), *[(c, text) for c in ("record_type", "record_id", "uri", "refers", "told_digest", "told_size")], ("block", pa.binary())])
    return files.mapInArrow(parse, "archive string, kind string, at long, end long, record_type string, record_id string, uri string, refers string, told_digest string, told_size string, block binary")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    scratch.cut(write_archives(table(spark, sf_dir, "pages"), folder), "written")
    back = read_archives(spark, folder).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, f"{_NAME}(-?[0-9]+)>", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("block").cast("long")).otherwise(F.col("told_size").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("block")).otherwise(F.substring("told_digest", 6, 40)).alias("payload_digest"),
        "record_type",
        F.when(~response, number("refers")).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM m
"""
