"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

The reader takes byte ranges of the archives. A task looks for gzip's magic bytes in its range, holds a place for a member
only if the bytes there inflate to a WARC header, and owns the records that start inside its range, reading past
the range's end for the last of them. No index and no pass over the whole file is needed.

Archives lie in the shared folder and are reached by pyarrow's file systems. A writing task names its files by a
random token and reports them; only files reported by tasks that succeeded are read, so retried and speculative tasks
leave nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import new_path, table, written

MAGIC = b"\x1f\x8b\x08"
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 18
MANIFEST = "path string, bytes long, records long"
RECORDS = "path string, offset long, record_type string, page_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, digest_holds boolean, payload binary"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: str | None, uri: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{page_id or ''}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, level: int = 6, file_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a gzip member per row and returns the manifest (path, bytes, records), itself a written table.

    Of equal payloads of at least ``min_bytes`` bytes, the row with the largest id becomes a response and the others revisit it; rows
    that repeat that id are responses too. A null id never wins over another and a null payload is empty. A null url
    leaves the target out; characters that a header can't hold are percent-encoded. Other columns are not read; an
    empty table gives no archive.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("sha"))
    # Only payloads that repeat have an entry; rows of a hot payload join it, and adaptive execution splits them.
    groups = rows.groupBy("sha", F.octet_length("html").alias("n")).agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("rows")).where(f"rows > 1 and n >= {min_bytes}").select("sha", "first")
    rows = rows.join(groups, "sha", "left").select(F.col("id").cast("string").alias("id"), "url", "html", F.col("first").cast("string").alias("first"), (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        done, out, path, at, n = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, text, first, revisit in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, at, n = f"{folder}/{name}", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = gz.compress(record(page_id.as_py(), url.as_py(), text.as_buffer().to_pybytes(), first.as_py(), revisit.as_py(), date)) + gz.flush()
                out.write(data)
                at, n = at + len(data), n + 1
                if at >= file_bytes:
                    out.close()
                    out = None
                    done.append((path, at, n))
        if out is not None:
            out.close()
            done.append((path, at, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "bytes", "records"])

    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def find_member(f: pa.NativeFile, at: int, end: int) -> int | None:
    """The first offset from at on, before end, where a gzip member begins that inflates to a WARC header."""
    while at < end:
        data = f.read_at(min(_STEP, end - at) + len(MAGIC) - 1, at)
        k = data.find(MAGIC)
        while k >= 0 and at + k < end:
            try:
                if zlib.decompressobj(31).decompress(f.read_at(4096, at + k), 64).startswith(b"WARC/"):
                    return at + k
            except zlib.error:
                pass
            k = data.find(MAGIC, k + 1)
        at += min(_STEP, end - at)
    return None


def members(f: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The members that begin in [start, end), with their offsets, whole even if they end after end."""
    at = find_member(f, start, end)
    while at is not None:
        inflate, parts, read = zlib.decompressobj(31), [], at
        while not inflate.eof:
            data = f.read_at(_STEP, read)
            if not data:
                raise ValueError(f"the member at {at} is cut short")
            read += len(data)
            parts.append(inflate.decompress(data))
        yield at, b"".join(parts)
        at = find_member(f, read - len(inflate.unused_data), end)


def parse(data: bytes) -> dict:
    """The fields of one record. Of a revisit, digest and length are those of the payload it stands for."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = lambda x: fields.get(x, "").strip("<>").removeprefix(_ID) or None
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out = {"record_type": fields["warc-type"], "page_id": name("warc-record-id"), "refers_to": name("warc-refers-to"), "target_uri": fields.get("warc-target-uri")}
    if out["record_type"] == "revisit":
        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
        return out | {"payload_bytes": length, "payload_digest": said, "digest_holds": None, "payload": None}
    digest = sha1_base32(payload)
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "digest_holds": said is None or said == digest, "payload": payload}


def read_archives(manifest: DataFrame, range_bytes: int = 32 << 20, payloads: bool = True, tasks_per_core: int = 8) -> DataFrame:
    """One row per record of the archives that manifest (path, bytes) lists; without payloads, those stay null.

    Ranges are dealt out over tasks in the order of the paths, to ``tasks_per_core`` tasks a core at most. Padding between members is skipped; a member that is cut short is an error.
    """
    ranges = manifest.where("bytes > 0").select("path", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start"), F.col("bytes"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    names = ["path", "offset", "record_type", "page_id", "refers_to", "target_uri", "payload_bytes", "payload_digest", "digest_holds", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=t) for n, t in zip(names, kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ranges in batches:
            for r in ranges.to_pylist():
                fs, at = _open(r["path"])
                with fs.open_input_file(at) as f:
                    rows, held = [], 0
                    for offset, data in members(f, r["start"], r["end"]):
                        row = {"path": r["path"], "offset": offset} | parse(data)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    tasks = min(max(1, ranges.count()), tasks_per_core * manifest.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start").mapInArrow(read, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = read_archives(write_archives(pages), payloads=False)
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


_GROUP = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[{i}] >> {s}) & 31) + 1)::BIGINT, 1)" for i in range(1, 9) for s in (15, 10, 5, 0))
OP1_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
         max(page_id) OVER (PARTITION BY html) AS first,
         list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS v
  FROM p)
SELECT page_id, payload_bytes, {_GROUP} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
