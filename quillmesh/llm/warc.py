"""WARC archives: a writer of one gzip member for each record, and a splittable reader.

Reader tasks get byte ranges of archives. A task scans its range for the gzip magic, takes a candidate for a member only
if its first bytes decode to a WARC version line, and owns every record that starts inside the range, wherever it ends.
Archives lie in the shared folder and are opened through Arrow's file systems, so any store with a URI will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import fresh_path, written

MAGIC = b"\x1f\x8b\x08"
MOST_TASKS, BROADCAST_ROWS = 50_000, 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(pairs: list[tuple[str, object]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None) + "\r\n").encode()


def _clean(value: str | None) -> str | None:
    """A header value on one line; control characters are percent-encoded."""
    return None if value is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed record. A revisit has the HTTP header of the page, whose Content-Length is the payload's, and no payload."""
    revisit = refers_to is not None
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
    ]
    return _header(head, "WARC/1.1") + block + b"\r\n\r\n"


def _writer(folder: str, level: int, date: str):
    schema = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        # A name of its own for each attempt: files of failed attempts are never listed, so never read.
        name, size, n, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, html, refers_to, n_bytes, sha1 in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, (html or "").encode(), n_bytes, digest, refers_to, date)) + z.flush()
                out.write(member)
                size += len(member)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], schema=schema)

    return run


def write_archives(
    pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    revisit_min_bytes: int = 0, level: int = 5, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes one record for each row and returns the archives: path, n_bytes, n_records.

    Of rows with equal payloads of at least ``revisit_min_bytes`` the smallest id is the response and the others revisit
    it; rows repeated with that id are each a response. Null html is an empty payload. A null id sorts after all others;
    equal payloads of null ids only are all responses.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumns({"n_bytes": F.octet_length("html").cast("long"), "sha1": F.sha1(F.col("html").cast("binary")), "sha2": F.sha2("html", 256)})
    keys = written(rows.drop("html", "url"), "warc-keys")
    # Counts meet by digest with map-side sums.
    first = keys.groupBy("sha1", "sha2", "n_bytes").agg(F.min("page_id").alias("first"))
    refers = F.when((F.col("n_bytes") >= revisit_min_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    links = keys.join(first, ["sha1", "sha2", "n_bytes"]).select(F.col("page_id").alias("p"), F.col("sha2").alias("s"), refers.alias("refers_to"))
    links = written(links.filter("refers_to IS NOT NULL").distinct(), "warc-links")
    # Few revisits ride along, so that the texts stay where they are; beyond the bound both sides move.
    links = F.broadcast(links) if links.count() <= BROADCAST_ROWS else links
    joined = rows.join(links, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha2") == F.col("s")), "left")
    out = joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "refers_to", "n_bytes", "sha1")
    return written(out.mapInArrow(_writer(folder, level, date), "path string, n_bytes long, n_records long"), "warc-files")


def _members(f: pa.NativeFile, start: int, end: int, size: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded members that start in [start, end)."""
    f.seek(start)
    buf, at, pos = b"", start, start  # buf holds the bytes from at on; pos is where the search goes on

    def fill(upto: int) -> None:
        nonlocal buf
        lacking = min(upto, size) - at - len(buf)
        if lacking > 0:
            more = f.read(max(lacking, min(chunk, size - at - len(buf))))
            if not more:
                raise EOFError(f"the archive ends before byte {size}")
            buf += more

    while pos < end:
        fill(pos + chunk)
        k = buf.find(MAGIC, pos - at)
        if k < 0:
            pos = max(pos, at + len(buf) - 2)
            buf, at = buf[pos - at :], pos
            if at + len(buf) >= size:
                return
            continue
        pos = at + k
        if pos >= end:
            return
        buf, at = buf[k:], pos
        z, out, used = zlib.decompressobj(31), [], 0
        try:
            fill(at + 4096)
            head = z.decompress(buf[:4096])
            used = min(4096, len(buf))
            if not head.startswith(b"WARC/1."):
                raise zlib.error("not a record")
            out.append(head)
            while not z.eof:
                fill(at + used + chunk)
                part = buf[used : used + chunk]
                if not part:
                    raise EOFError(f"a member at byte {pos} is cut off")
                out.append(z.decompress(part))
                used += len(part)
        except zlib.error:
            if out:
                raise
            pos += 1
            continue
        pos = at + used - len(z.unused_data)
        buf, at = buf[pos - at :], pos
        yield b"".join(out)


def parse_record(data: bytes) -> dict:
    """Headers, HTTP header and payload of a record; raises where lengths or digests disagree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError(f"record {fields['WARC-Record-ID']} has {len(rest)} bytes after its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def _reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(at) as f:
                    for data in _members(f, start, end, size):
                        rows.append(parse_record(data))
                        if not with_payload:
                            rows[-1]["payload"] = None
                        held += len(rows[-1]["payload"] or b"")
                        if len(rows) >= 2048 or held > 1 << 25:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(files: DataFrame, *, split_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """The records of ``files`` (path, n_bytes), read in ranges of ``split_bytes``. A revisit's payload is null; its length and digest are the full payload's."""
    ranges = files.filter("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(split_bytes))).alias("start"), "n_bytes")
    ranges = ranges.select("path", F.col("start").cast("long").alias("start"), F.least(F.col("start") + split_bytes, "n_bytes").cast("long").alias("stop"), "n_bytes")
    # A number of tasks of its own: ranges are tiny rows, which adaptive execution would put in one task.
    n = files.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(n), MOST_TASKS))
    out = ranges.mapInArrow(_reader(with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if with_payload else out.drop("payload")
