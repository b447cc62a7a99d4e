"""WARC archives: a deduplicating writer and a salvage reader.

Writer: one gzip member per record, rolled over at ``ARCHIVE_BYTES``. Of the
records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with
the smallest id is a response, the others are revisits without payload. Tasks
write archives straight to the shared folder under names of their own; only
the archives that a successful task reports are in the manifest, so a repeated
task leaves at most an unread file.

Reader: takes records member by member (gzip) or record by record (plain).
When a check fails - damaged deflate data, header, length or digest - it
searches for the next member magic or version line, goes on with the first
place that holds a valid record, and logs the bytes in between as a gap.
Memory holds one record and one read block.

A null payload is empty; empty and short payloads are always responses. A
null url leaves the target out. Repeated rows with the same id and payload
are all responses (each has the smallest id); a null id is written as such and
is never referred to.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.common import byte_texts, read, scratch_path, small_batches, written

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
#: Largest number of shared digests whose table is broadcast (about 100 bytes each).
BROADCAST_DIGESTS = 100_000
BLOCK = 1 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d\r\n")


def record(kind: str, key, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record. ``digest`` and the payload length are those of the full payload."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{key}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """The record that fills ``data``; ValueError if a check fails."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0 or not data.startswith(b"WARC/"):
        raise ValueError("header")
    head = {}
    for line in data[:cut].decode("utf-8", "strict").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header")
        head[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        raise ValueError("length")
    end = cut + 4 + int(head["content-length"])
    if data[end:] != b"\r\n\r\n":
        raise ValueError("length")
    payload = data[cut + 4 : end]
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if head.get("warc-type") == "response" and digest != hashlib.sha256(payload).hexdigest():
        raise ValueError("digest")
    return {"head": head, "payload": payload}


class _Window:
    """Forward reading with a buffer that starts at ``base``."""

    def __init__(self, stream):
        self.stream, self.buf, self.base, self.ended = stream, b"", 0, False

    def more(self) -> bool:
        block = b"" if self.ended else self.stream.read(BLOCK)
        self.ended = not block
        self.buf += block
        return bool(block)

    def drop(self, n: int) -> None:
        self.buf, self.base = self.buf[n:], self.base + n


def _gzip_record(w: _Window) -> tuple[dict, int]:
    """The record in the member at the window's start, and the member's size."""
    z, fed, out = zlib.decompressobj(31), 0, []
    while not z.eof:
        if fed == len(w.buf) and not w.more():
            raise ValueError("truncated member")
        part = w.buf[fed : fed + BLOCK]
        fed += len(part)
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            raise ValueError("member") from e
        if len(out) == 1 and out[0] and not out[0].startswith(b"WARC/"[: len(out[0])]):
            raise ValueError("no record in member")
    return parse(b"".join(out)), fed - len(z.unused_data)


def _plain_record(w: _Window) -> tuple[dict, int]:
    while (cut := w.buf.find(b"\r\n\r\n")) < 0:
        if len(w.buf) > BLOCK or not w.more():
            raise ValueError("header")
    found = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", w.buf[: cut + 2], re.I)
    if not found:
        raise ValueError("length")
    size = cut + 4 + int(found[1]) + 4
    while len(w.buf) < size:
        if not w.more():
            raise ValueError("truncated record")
    return parse(w.buf[:size]), size


def salvage(stream) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, end, record, reason): records have no reason, gaps no record."""
    w = _Window(stream)
    gap, why = None, ""
    while w.buf or w.more():
        while len(w.buf) < 16 and w.more():
            pass
        try:
            if w.buf.startswith(b"\x1f\x8b\x08"):
                found, size = _gzip_record(w)
            elif w.buf.startswith(b"WARC/"):
                found, size = _plain_record(w)
            else:
                raise ValueError("no record start")
        except (ValueError, UnicodeDecodeError) as e:
            if gap is None:
                gap, why = w.base, str(e)
            # The next start lies after this byte; keep enough for one that is cut by the buffer's end.
            while not (at := _START.search(w.buf, 1)):
                w.drop(max(1, len(w.buf) - 12) if len(w.buf) > 13 else 0)
                if not w.more():
                    w.drop(len(w.buf))
                    break
            else:
                w.drop(at.start())
            continue
        if gap is not None:
            yield gap, w.base, None, why
            gap = None
        yield w.base, w.base + size, found, ""
        w.drop(size)
    if gap is not None:
        yield gap, w.base, None, why


def _storage(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def with_references(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """``pages`` with ``__digest`` and ``__refers_to`` (the response's id for revisits).

    The digests that several rows share are found on a narrow projection; the
    rows themselves move only if that table is too large to broadcast."""
    digest = F.sha2(F.coalesce(F.col(payload), F.lit("")), 256)
    long_enough = F.octet_length(F.coalesce(F.col(payload), F.lit(""))) >= REVISIT_BYTES
    shared = (pages.filter(long_enough).select(digest.alias("__digest"), F.col(key).alias("__k"))
              .groupBy("__digest").agg(F.min("__k").alias("__first"), F.count(F.lit(1)).alias("__n"))
              .filter("__n > 1 AND __first IS NOT NULL").select("__digest", "__first"))
    shared = written(shared, "warc-digests")
    side = F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared
    out = pages.withColumn("__digest", digest).join(side, "__digest", "left")
    other = ~F.col(key).eqNullSafe(F.col("__first"))
    return out.withColumn("__refers_to", F.when(F.col("__first").isNotNull() & other, F.col("__first"))).drop("__first")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives under ``folder``; returns the manifest
    (archive, bytes, records)."""
    spark = pages.sparkSession
    small_batches(spark)
    _storage(folder)[0].create_dir(_storage(folder)[1], recursive=True)
    rows = with_references(pages, key, payload).select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(payload).alias("p"), F.col("__digest").alias("d"), F.col("__refers_to").alias("r"))

    def run(batches):
        fs, root = _storage(folder)
        out, name, size, n = None, "", 0, 0
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

        try:
            for b in batches:
                k, u, d, r = (b.column(c).to_pylist() for c in "kudr")
                for kk, uu, pp, dd, rr in zip(k, u, byte_texts(b.column("p")), d, r, strict=True):
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    data = member(record("response" if rr is None else "revisit", kk, uu, pp, dd, rr, date))
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= ARCHIVE_BYTES:
                        yield done()
                        out = None
            if out is not None:
                yield done()
                out = None
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, "archive string, bytes long, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records and gaps of the archives named by ``manifest.archive``.

    Records: ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to`` (and ``payload``); gaps: ``record_type`` 'gap' and the ``reason``.
    ``start`` and ``end`` are byte offsets in the archive."""
    n = max(1, manifest.count())
    schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("reason", pa.string()),
                        ("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.string()), ("payload", pa.binary())])

    def page(x: str | None) -> str | None:
        x = x.removeprefix("<urn:x-page:").removesuffix(">") if x else None
        return None if x == "None" else x

    def run(batches):
        for b in batches:
            for archive in b.column("archive").to_pylist():
                fs, path = _storage(archive)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for start, end, found, why in salvage(f):
                        row = {"archive": archive, "start": start, "end": end, "record_type": "gap", "reason": why}
                        if found:
                            h = found["head"]
                            revisit = h.get("warc-type") == "revisit"
                            row |= {"record_type": h.get("warc-type"), "reason": None, "page_id": page(h.get("warc-record-id")), "url": h.get("warc-target-uri"),
                                    "payload_bytes": int(h.get("x-payload-length", 0)) if revisit else len(found["payload"]),
                                    "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to": page(h.get("warc-refers-to"))}
                            if with_payload:
                                row["payload"] = found["payload"]
                                held += len(found["payload"])
                        rows.append(row)
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("archive").repartition(n).mapInArrow(
        run, "archive string, start long, end long, record_type string, reason string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch_path(spark, "warc"))
    found = read_archives(manifest, with_payload=False).filter("record_type <> 'gap'")
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""
