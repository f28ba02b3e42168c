"""WARC records in ZIP packages, written and range-read without extraction (operator 1).

An archive is a ZIP file with two stored (uncompressed) members:

* ``archive/data.warc.gz`` - WARC/1.1 records, one gzip member per record;
* ``indexes/index.cdxj``   - one JSON line per record: offset and length of
  its gzip member within the archive member.

The central directory is written with ZIP64 records where sizes, offsets or
counts need them.  The reader looks at the end of the file, follows the ZIP64
locator if there is one, parses the central directory, and reads only the
directory, the index and the byte ranges of records.

Each task writes its archives under names of its own attempt and returns their
manifest (path and size).  The manifest is committed by Spark's Parquet
writer, and only archives in the manifest are ever read: what a lost or
repeated task leaves behind is no part of the result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import scratch_path, stored, stored_at

MIN_REVISIT = 100                 # payloads below this many bytes are always stored
MAX_ARCHIVE = 256 * 1024 * 1024   # a task starts a new archive beyond this size
MAX_RECORDS = 100_000             # ... or this many records (its index is held in memory)
RANGE_BYTES = 4 * 1024 * 1024     # records are read in ranges of about this size
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EXACT_URL = "X-Url-Json"
_DATE = "2024-01-01T00:00:00Z"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


# ---- records -------------------------------------------------------------

def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, rtype: str) -> bytes:
    """One WARC record; a revisit has the digest and size of its payload but not the payload.

    A url that a header field cannot hold as it is (null, line breaks, outer
    white space) is there in an escaped form, and as JSON text in a field of
    its own, which :func:`url_of` reads.
    """
    body = payload if rtype == "response" else b""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A").strip()
    heads = [
        ("WARC-Type", rtype), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"),
    ]
    if uri != url:
        heads.append((EXACT_URL, json.dumps(url)))
    if rtype == "revisit":
        heads += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    heads.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one WARC record; raises if it isn't whole."""
    end = raw.index(b"\r\n\r\n")
    first, *lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    heads = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(heads["Content-Length"])
    body = raw[end + 4:end + 4 + n]
    if len(body) != n or raw[end + 4 + n:] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    return heads, body


def url_of(heads: dict[str, str]) -> str | None:
    """The url that a record was written with, null included."""
    return json.loads(heads[EXACT_URL]) if EXACT_URL in heads else heads["WARC-Target-URI"]


# ---- ZIP -----------------------------------------------------------------

class ZipWriter:
    """Stored members, written front to back; sizes follow in data descriptors."""

    def __init__(self, out, force_zip64: bool = False):
        self.out, self.at, self.force, self.done = out, 0, force_zip64, []

    def write(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)
        if self.done and self.done[-1]["open"]:
            m = self.done[-1]
            m["crc"] = zlib.crc32(b, m["crc"])
            m["size"] += len(b)

    def open(self, name: str) -> None:
        raw = name.encode()
        at = self.at
        # Version 4.5, sizes to follow (bit 3), UTF-8 name (bit 11); the ZIP64 field says descriptors are 8 bytes wide.
        self.write(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, _FULL32, _FULL32, len(raw), 20)
                   + raw + struct.pack("<2H2Q", 1, 16, 0, 0))
        self.done.append({"name": raw, "at": at, "crc": 0, "size": 0, "open": True})

    def close_member(self) -> None:
        m = self.done[-1]
        m["open"] = False
        self.write(struct.pack("<4sI2Q", b"PK\7\10", m["crc"], m["size"], m["size"]))

    def finish(self) -> None:
        start = self.at
        for m in self.done:
            wide = self.force or m["size"] >= _FULL32 or m["at"] >= _FULL32
            extra = struct.pack("<2H3Q", 1, 24, m["size"], m["size"], m["at"]) if wide else b""
            size, at = (_FULL32, _FULL32) if wide else (m["size"], m["at"])
            self.write(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, m["crc"], size, size,
                                   len(m["name"]), len(extra), 0, 0, 0, 0, at) + m["name"] + extra)
        n, length, wide = len(self.done), self.at - start, self.force or self.at >= _FULL32 or len(self.done) >= _FULL16
        if wide:
            end = self.at
            self.write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start))
            self.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, *((_FULL16, _FULL16, _FULL32, _FULL32) if wide else (n, n, length, start)), 0))


def members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (start of data, length, crc) of the stored members of a ZIP file.

    ``f`` needs seek and read.  Only the end of the file, the central directory
    and the members' local headers are read.
    """
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 22 - _FULL16)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(b"PK\5\6")
    if k < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = struct.unpack("<4s4H2IH", tail[k:k + 22])
    if k >= 20 and tail[k - 20:k - 16] == b"PK\6\7":
        end64 = struct.unpack("<4sIQI", tail[k - 20:k])[2]
        _, _, _, _, _, _, _, n, length, start = struct.unpack("<4sQ2H2I4Q", read(end64, 56))
    directory = read(start, length)
    out, p = {}, 0
    for _ in range(n):
        sig, _, _, flags, method, _, _, crc, packed, plain, ln, le, lc, _, _, _, at = struct.unpack("<4s6H3I5H2I", directory[p:p + 46])
        if sig != b"PK\1\2":
            raise ValueError("bad central directory entry")
        name, extra = directory[p + 46:p + 46 + ln], directory[p + 46 + ln:p + 46 + ln + le]
        p += 46 + ln + le + lc
        q = 0
        while q + 4 <= len(extra):      # ZIP64 field: the values that are full above, in this order
            tag, m = struct.unpack("<2H", extra[q:q + 4])
            if tag == 1:
                wide = list(struct.unpack(f"<{m // 8}Q", extra[q + 4:q + 4 + m // 8 * 8]))
                plain = wide.pop(0) if plain == _FULL32 else plain
                packed = wide.pop(0) if packed == _FULL32 else packed
                at = wide.pop(0) if at == _FULL32 else at
            q += 4 + m
        if method == 0:
            local = read(at, 30)
            if local[:4] != b"PK\3\4":
                raise ValueError("bad local header")
            a, b = struct.unpack("<2H", local[26:30])
            out[name.decode("utf-8" if flags & 0x800 else "cp437")] = (at + 30 + a + b, packed, crc)
    return out


# ---- on Spark ------------------------------------------------------------

def record_plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, record_type, refers_to for every row of ``pages``.

    Of rows with equal payloads of 100 bytes or more the smallest page_id is
    the response and the others revisit it.  A null html is an empty payload.
    Null ids are larger than any other; rows that repeat the response's id are
    responses too, as is every row of a group that has only null ids.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= MIN_REVISIT, F.sha2("payload", 256)))
    # Stored, so that both inputs of the join are plain shuffles and a payload that
    # a third of the rows share is split at run time.  Only groups matter.
    first = stored(rows.where("digest is not null").select("page_id", "digest").groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1").select(F.col("digest").alias("d"), "first"), "warc-first")
    rows = rows.join(first, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, F.col("first")).alias("refers_to"))


def _filesystem(path: str):
    """Shared folders of local, HDFS or object stores; a plain path is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(records: DataFrame, out: str) -> DataFrame:
    """Write the rows of :func:`record_plan` as archives under ``out``; their manifest (path, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(out)
        z = sink = path = None
        index: list[str] = []

        def close() -> pa.RecordBatch:
            z.close_member()
            z.open(INDEX)
            z.write("".join(index).encode())
            z.close_member()
            z.finish()
            sink.close()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([z.at], pa.int64())], names=["path", "bytes"])

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "record_type", "refers_to")]
            for row in zip(*cols):
                page_id, url, payload, rtype, refers = (x.as_py() for x in row)
                if z is None:
                    files.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    sink = files.open_output_stream(path)
                    z = ZipWriter(sink)
                    z.open(DATA)
                raw = gzip.compress(record_bytes(page_id, url, payload, refers, rtype), 1, mtime=0)
                index.append(json.dumps({"id": page_id, "offset": z.done[0]["size"], "length": len(raw)}) + "\n")
                z.write(raw)
                if z.at >= MAX_ARCHIVE or len(index) >= MAX_RECORDS:
                    yield close()
                    z = None
        if z is not None:
            yield close()

    manifest = records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "path string, bytes long")
    return stored_at(manifest, f"{out}-manifest")


def archive_ranges(manifest: DataFrame, root: str) -> DataFrame:
    """(path, start, length) of byte ranges that hold whole records, from directories and indexes alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(root)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                with files.open_input_file(path) as f:
                    where = members(f, size)
                    data, _, _ = where[DATA]
                    at, length, crc = where[INDEX]
                    f.seek(at)
                    lines = f.read(length)
                if zlib.crc32(lines) != crc:
                    raise ValueError(f"damaged index in {path}")
                starts, lengths = [], []
                for line in io.BytesIO(lines):
                    e = json.loads(line)
                    if not starts or lengths[-1] >= RANGE_BYTES:
                        starts.append(data + e["offset"])
                        lengths.append(0)
                    lengths[-1] += e["length"]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                                                 names=["path", "start", "length"])

    return manifest.mapInArrow(run, "path string, start long, length long")


def read_records(ranges: DataFrame, root: str) -> DataFrame:
    """page_id, record_type, refers_to, url, payload_bytes, payload_digest of every record in the ranges.

    Each record is unpacked and parsed; a response's size and digest are taken
    from its payload and must agree with its header, a revisit's come from its
    header.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(root)

        def number(urn: str | None) -> int | None:
            digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
            return int(digits) if digits else None

        for batch in batches:
            for path, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
                with files.open_input_file(path) as f:
                    f.seek(start)
                    raw = f.read(length)
                out: list[tuple] = []
                while raw:
                    unzip = zlib.decompressobj(31)
                    heads, body = parse_record(unzip.decompress(raw))
                    raw = unzip.unused_data
                    n, digest = int(heads["X-Payload-Length"]), heads["WARC-Payload-Digest"].removeprefix("sha256:")
                    if heads["WARC-Type"] == "response" and (n, digest) != (len(body), hashlib.sha256(body).hexdigest()):
                        raise ValueError(f"damaged payload in {path}")
                    out.append((number(heads["WARC-Record-ID"]), n, digest, heads["WARC-Type"], number(heads.get("WARC-Refers-To")), url_of(heads)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    spread = ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all ``pages`` as archives in the shared folder and read every record back.

    Ids and urls come back as they were, null, white space and line breaks included.
    """
    out = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(record_plan(pages), out)
    return read_records(archive_ranges(manifest, out), out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, url
FROM f
"""
