"""WARC archives with a two-level capture index.

Tasks write gzip-per-record archives into the shared folder and return index rows. The rows are sorted by
reversed-host URL key into compressed blocks of some thousand lines; a sparse directory has the first key of each
block. A lookup finds the index part by its first keys (a row for each part), binary-searches the part's directory,
opens the blocks that can hold the key, and range-reads the records.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import durable, sub_batches, work_dir

BLOCK_LINES = 3000

CAPTURE = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("archive", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("digest", T.StringType()),
])
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: hosts of one domain sort together. Empty for null."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:  # no such port, or an unclosed bracket: the URL is its own key
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that all executors share, and the path in it."""
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), os.path.abspath(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no block, but the digest and length of the payload it stands for."""
    headers = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", json.dumps(url)[1:-1] if url is not None else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if is_revisit else None),
        ("X-Page-Id", page_id), ("X-Payload-Length", len(payload)), ("X-Refers-To-Page-Id", refers_to),
        ("Content-Type", "text/html"),
        ("Content-Length", 0 if is_revisit else len(payload)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + "\r\n"
    return head.encode() + (b"" if is_revisit else payload) + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one record; a response's digest and length are checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines)
    payload = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and sha1_base32(payload) != digest:
        raise ValueError(f"payload of page {fields.get('X-Page-Id')} doesn't have its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": json.loads(f'"{fields["WARC-Target-URI"]}"') if "WARC-Target-URI" in fields else None,
        "payload_bytes": len(payload) if kind == "response" else number("X-Payload-Length"), "payload_digest": digest, "record_type": kind,
        "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None,
    }


def with_revisits(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, is_revisit: of equal payloads the largest page_id is the response.

    Rows that repeat a page_id are one page's copies: none of them revisits itself. A null html is an empty payload. A null
    page_id is less than any other, and a page with it revisits nothing. A very long page is taken whole. No rows give
    none. Other columns aren't read, whatever their names.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"_digest": F.sha2("payload", 256), "_size": F.octet_length("payload")})
    shared = rows.filter(F.col("_size") >= min_bytes).groupBy("_digest", "_size").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_least"))
    # Written, since Spark splits the rows of a hot payload only in a join that no aggregate stands before.
    shared = durable(shared.filter("_last > _least").select("_digest", "_size", "_last"), "shared-payloads")
    joined = rows.join(shared, ["_digest", "_size"], "left")
    revisit = F.col("_last").isNotNull() & F.coalesce(F.col("page_id") != F.col("_last"), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("_last")).alias("refers_to"), revisit.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write records to archives under ``folder`` and return their captures.

    A task that runs again writes an archive of its own name, and only the rows of the run that counts name it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        out, name, at = None, f"{base}/{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in sub_batches(batches, "payload"):
                rows = []
                for r in batch.to_pylist():
                    payload = r["payload"]
                    digest = sha1_base32(payload)
                    raw = gzip.compress(record_bytes(r["page_id"], r["url"], payload, digest, r["refers_to"], r["is_revisit"]), 4, mtime=0)
                    if out is None:
                        files.create_dir(base, recursive=True)
                        out = files.open_output_stream(name, compression=None)
                    out.write(raw)
                    rows.append({"url_key": url_key(r["url"]), "page_id": r["page_id"], "archive": os.path.basename(name), "offset": at, "size": len(raw), "digest": digest})
                    at += len(raw)
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("digest", pa.string())]))
        finally:
            if out is not None:
                out.close()

    # The rows are written at once, so that the archives they name are those of one run of each task.
    return durable(pages.mapInArrow(run, CAPTURE), "captures")


PARTS = T.StructType([T.StructField("first_key", T.StringType()), T.StructField("part", T.StringType())])


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Sorted, compressed blocks with a directory for each part. Returns (first key, part), a row for each partition.

    A key with many captures may cross blocks and parts; lookups go on until the key ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        name, out, at, lines, directory = f"{base}/{uuid.uuid4().hex}", None, 0, [], []

        def flush() -> None:
            nonlocal at, lines
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(raw)
            directory.append([lines[0][0], at, len(raw)])
            at, lines = at + len(raw), []

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(name + ".cdx", compression=None)
                lines.append(list(r))
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with files.open_output_stream(name + ".dir", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_pydict({"first_key": [directory[0][0]], "part": [os.path.basename(name)]})

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range is over (key, page): captures of one key spread over parts if there are very many.
    ordered = captures.repartitionByRange(parts, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "archive", "offset")
    return sorted((r.first_key, r.part) for r in durable(ordered.mapInArrow(run, PARTS), "index-parts").collect())  # one row for each partition


class CaptureIndex:
    """Binary search over the parts, a part's directory and a block, with the last part and block kept."""

    def __init__(self, folder: str, parts: list[tuple[str, str]]):
        self.files, self.base = store(folder)
        self.keys, self.names = [k for k, _ in parts], [p for _, p in parts]
        self._directory: tuple = (None, None, None)
        self._block: tuple = (None, None, None)

    def _part(self, k: int) -> tuple[list[str], list[list]]:
        if self._directory[0] != k:
            with self.files.open_input_file(f"{self.base}/{self.names[k]}.dir") as f:
                entries = json.loads(zlib.decompress(f.read()))
            self._directory = (k, [e[0] for e in entries], entries)
        return self._directory[1:]

    def _lines(self, k: int, b: int) -> tuple[list[str], list[list]]:
        if self._block[0] != (k, b):
            _, at, size = self._part(k)[1][b]
            with self.files.open_input_file(f"{self.base}/{self.names[k]}.cdx") as f:
                f.seek(at)
                lines = [json.loads(x) for x in zlib.decompress(f.read(size)).decode().split("\n")]
            self._block = ((k, b), [x[0] for x in lines], lines)
        return self._block[1:]

    def find(self, key: str) -> Iterator[list]:
        """Captures of ``key``: [url_key, page_id, archive, offset, size, digest]."""
        # The last part that begins before the key may hold its first captures; later ones follow while they begin with it.
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        while k < len(self.keys) and self.keys[k] <= key:
            firsts, entries = self._part(k)
            b = max(0, bisect.bisect_left(firsts, key) - 1)
            while b < len(entries) and firsts[b] <= key:
                keys, lines = self._lines(k, b)
                yield from lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                b += 1
            k += 1


def lookup(urls: DataFrame, archives: str, index: str, parts: list[tuple[str, str]], *, url: str = "url") -> DataFrame:
    """All records captured under the distinct keys of ``urls``; keys without captures give none."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"url_key": list(map(url_key, batch.column(0).to_pylist()))})

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = CaptureIndex(index, parts)
        for batch in batches:
            rows: list[list] = []
            for key in batch.column(0).to_pylist():
                for line in found.find(key):
                    rows.append(line)
                    if len(rows) >= 10_000:  # a key with very many captures goes on in pieces
                        yield pack(rows)
                        rows = []
            if rows:
                yield pack(rows)

    def pack(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], CAPTURE.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(archives)
        name, handle, rows, size = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "size"))):
                if archive != name:
                    if handle is not None:
                        handle.close()
                    name, handle = archive, files.open_input_file(f"{base}/{archive}")
                handle.seek(offset)
                rows.append(parse_record(gzip.decompress(handle.read(length))))
                size += rows[-1]["payload_bytes"]
                if size > 8 << 20:
                    yield records(rows)
                    rows, size = [], 0
        if rows:
            yield records(rows)
        if handle is not None:
            handle.close()

    def records(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = urls.select(url).mapInArrow(keys, T.StructType([T.StructField("url_key", T.StringType())])).distinct()
    # Keys in order open each block once. What they find is dealt out anew: one key may have a third of all captures.
    found = wanted.repartitionByRange(n, "url_key").sortWithinPartitions("url_key").mapInArrow(captures, CAPTURE)
    spread = found.repartition(n, F.col("archive"), F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(read, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = work_dir(spark, "warc")
    captures = write_archives(with_revisits(pages), f"{folder}/archives")
    parts = write_index(captures, f"{folder}/index")
    return lookup(pages, f"{folder}/archives", f"{folder}/index", parts).drop("payload")


OP1_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INT))) & 31), 1)), 'string_agg', '') AS digest FROM p)
SELECT page_id, url, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
