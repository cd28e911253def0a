"""WARC archives: gzip members with payload deduplication, and a salvage reader that recovers what follows damage."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, scratch, shared_path

VERSION = b"WARC/1.1\r\n"
#: Version lines that the reader accepts and searches for.
VERSIONS = (b"WARC/1.0\r\n", VERSION)
MEMBER = b"\x1f\x8b\x08"
CHUNK = 1 << 18
#: Bytes in which a plain record's headers must end; a version line without such an end is not a record's start.
HEADERS = 1 << 26
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    """Quarantined bytes: from `offset`, `length` of them (in the file as stored), and why."""

    offset: int
    length: int
    reason: str


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_of_hex(digest):
    """Column expression: a SHA-1 in hexadecimal (40 digits) as base32 (32 letters, upper case)."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 2), 40, "0") for k in range(4)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.substring(F.lit(_BASE32), (F.conv(F.substring(bits, k * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1), F.lit(1))), "")


def format_record(kind: str, record_id: str, uri: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", uri)), *extra]
    head += [("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def http_block(payload: bytes | None, length: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return head + (payload or b"")


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], bytes, int] | str:
    """(headers, block, bytes used) of the record at `at` in data, or what is wrong with it.

    Header lines that begin with white space go on with the value of the line before.
    """
    if not any(data.startswith(v, at) for v in VERSIONS):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers don't end"
    headers: dict[str, str] = {}
    last = ""
    for line in bytes(data[at + len(VERSION) : end]).split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:
            headers[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header"
        last = name.decode("utf-8", "replace").strip().lower()
        headers[last] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "no content length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "record doesn't end"
    block = bytes(data[start:stop])
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        return "block digest differs"
    return headers, block, stop + 4 - at


class _Window:
    """A sliding window over a stream, so that a file of any size is read in bounded memory (that of its largest record)."""

    def __init__(self, stream) -> None:
        self.stream, self.data, self.at, self.done = stream, bytearray(), 0, False

    def more(self) -> bool:
        if not self.done:
            block = self.stream.read(CHUNK)
            self.done = not block
            self.data += block
        return not self.done

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def peek(self, at: int, n: int) -> bytes | None:
        """n bytes at `at` of the window (fewer at the stream's end), without holding what lies before them; None if the stream can't seek."""
        if at + n <= len(self.data):
            return bytes(self.data[at : at + n])
        if self.done:
            return bytes(self.data[at : at + n])
        if not self.stream.seekable():
            return None
        here = self.stream.tell()
        try:
            # Offsets in the file differ from `at` where the stream didn't begin at 0.
            self.stream.seek(here - len(self.data) + at)
            return self.stream.read(n)
        finally:
            self.stream.seek(here)


def _member(window: _Window, most: int | None) -> tuple[bytes, int] | str:
    """(content, bytes used) of the gzip member at the window's start."""
    unpack, fed, out, size = zlib.decompressobj(31), 0, [], 0
    try:
        while not unpack.eof:
            if fed == len(window.data) and not window.more():
                return "member is cut short"
            piece = unpack.decompress(bytes(window.data[fed : fed + CHUNK]))
            fed = min(fed + CHUNK, len(window.data))
            size += len(piece)
            if most is not None and size > most:
                return "member is above the caller's limit"
            out.append(piece)
    except zlib.error as e:
        return f"bad member: {e}"[:60]
    return b"".join(out), fed - len(unpack.unused_data)


def _plain(window: _Window, most: int | None) -> tuple[dict[str, str], bytes, int] | str:
    """The uncompressed record at the window's start; reads on while it is incomplete."""
    seen = 0
    while (end := window.data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
        seen = len(window.data)
        # A start that is no record's: headers are short.
        if seen > HEADERS or not window.more():
            return "headers don't end"
    size = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", bytes(window.data[:end]), re.I)
    need = end + 8 + int(size[1]) if size else 0
    if most is not None and need > most:
        return "record is above the caller's limit"
    # A damaged length is seen at the record's end, before what lies between is read.
    if need and window.peek(need - 4, 4) not in (None, b"\r\n\r\n"):
        return "record doesn't end"
    while len(window.data) < need and window.more():
        pass
    return parse_record(window.data)


def _records_of(content: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str]:
    """The records of a member's content up to the first that fails its checks, and what is wrong there (or nothing)."""
    found, at = [], 0
    while at < len(content):
        record = parse_record(content, at)
        if isinstance(record, str):
            return found, record
        found.append(record[:2])
        at += record[2]
    return found, "" if found else "empty member"


def salvage(stream, most: int | None = None) -> Iterator[Record | Gap]:
    """All records of a WARC stream (versions 1.0 and 1.1) whose checks hold, and the gaps between them, in order of offset.

    Members may be compressed (gzip, one or more records each) or plain.  Where a check fails (member checksum, version line,
    headers, length, record end, block digest), the reader goes on byte by byte to the next place at which a whole member or record
    passes all checks; what lies before is one gap.  Records and gaps together cover every byte once: of the records in one member
    the first has the member's bytes, and the others a length of 0 at its offset, as has a gap inside a member, whose other records are kept.
    Records have no size limit: what is held in memory is one record, or one member's content.  A caller who must bound that sets
    `most`; larger records are then gaps that say so.  A plain record is read only if a record's end stands where its length says, so a
    damaged length doesn't pull in the rest of the file; streams that can't seek are read up to that place.  Headers above 64 MiB are gaps.
    """
    window = _Window(stream)
    gap_at, gap_reason = None, ""
    while window.data or window.more():
        found: list[Record] = []
        wrong = inside = ""
        used = 0
        if window.data[:2] == MEMBER[:2] or len(window.data) < 3:
            got = _member(window, most)
            if isinstance(got, str):
                wrong = got
            else:
                records, inside = _records_of(got[0])
                used = got[1]
                found = [Record(window.at, 0 if k else used, *r) for k, r in enumerate(records)]
                wrong = "" if found else inside
        elif window.data.startswith(b"WARC/") or len(window.data) < len(VERSION) and window.more():
            plain = _plain(window, most)
            if isinstance(plain, str):
                wrong = plain
            else:
                used = plain[2]
                found = [Record(window.at, used, plain[0], plain[1])]
        else:
            wrong = "neither a member nor a version line"
        if found:
            if gap_at is not None:
                yield Gap(gap_at, window.at - gap_at, gap_reason)
                gap_at = None
            yield from found
            if inside:
                yield Gap(window.at, 0, f"in a member: {inside}")
            window.skip(used)
            continue
        if gap_at is None:
            gap_at, gap_reason = window.at, wrong
        # On to the next place that looks like a start.
        step = 1
        while True:
            places = [p for p in (window.data.find(mark, step) for mark in (MEMBER, *VERSIONS)) if p >= 0]
            if places:
                window.skip(min(places))
                break
            keep = min(len(window.data), len(VERSION) - 1)
            window.skip(max(len(window.data) - keep, min(1, len(window.data))))
            step = 0
            if not window.more():
                window.skip(len(window.data))
                break
    if gap_at is not None:
        yield Gap(gap_at, window.at - gap_at, gap_reason)


def resolve_duplicates(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, digest, payload_digest, refers_to): digest is in hexadecimal; refers_to is the response's page_id for revisits, else null.

    Of the records with equal payloads (UTF-8 of html, null as empty) of at least `min_bytes`, that with the largest page_id
    is the response.  Digests are combined map-side first, so a payload that a third of the pages share costs one row a task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", F.length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"))
    hashed = scratch(hashed, "digests")
    last = hashed.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = hashed.join(last, F.col("digest") == F.col("d"), "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("page_id") < F.col("last"))
    return joined.select("page_id", "payload_bytes", "digest", base32_of_hex(F.col("digest")).alias("payload_digest"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archives: int | None = None, level: int = 6) -> DataFrame:
    """Write one WARC record per row of pages (page_id, url, html) into gzip archives under `folder`.

    Returns the manifest, as a table in the shared folder: (path, n_records, n_bytes), one row per finished archive.  An
    archive that a failed or repeated task attempt left behind is not in the manifest, and so is never read.
    """
    spark = pages.sparkSession
    resolved = resolve_duplicates(pages, min_bytes)
    # Rows with one page_id and several payloads keep a digest each.
    resolved = resolved.groupBy(F.col("page_id").alias("id"), F.col("digest").alias("known")).agg(F.max("payload_digest").alias("payload_digest"), F.max("refers_to").alias("refers_to"))
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    rows = rows.join(resolved, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("known"))).select("page_id", "url", "html", "payload_digest", "refers_to")
    if archives:
        rows = rows.repartition(archives, "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        name = f"{base}/pages-{uuid.uuid4().hex}.warc.gz"
        n = size = 0
        sink = None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(name, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                ident = lambda k, d: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{k}/{d}')}"
                extra = [("WARC-Payload-Digest", "sha1:" + digest), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
                if refers_to is not None:
                    extra += [("WARC-Refers-To", f"<{ident(refers_to, digest)}>"), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                kind = "response" if refers_to is None else "revisit"
                block = http_block(payload if refers_to is None else None, len(payload))
                member = gzip_member(format_record(kind, ident(page_id, digest), url or "", block, extra), level)
                sink.write(member)
                n, size = n + 1, size + len(member)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name if "://" not in folder or folder.startswith("file:") else f"{folder}/{os.path.basename(name)}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])

    return scratch(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Salvage all records of the archives in `manifest` (path, ...).

    Returns a row per record: path, offset, length, record_type, page_id, payload_bytes, payload_digest (recomputed for
    responses), refers_to, payload (null for revisits); and a row per quarantined gap with record_type `gap`, where
    `reason` says which check failed and the other columns are null.  Archives are streamed, one record at a time.
    """
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])
        number = lambda x: int(x) if x else None

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                rows, held = [], 0
                with store.open_input_file(name) as stream:
                    for found in salvage(stream):
                        if isinstance(found, Gap):
                            rows.append((path, found.offset, found.length, "gap", None, None, None, None, None, found.reason))
                        else:
                            h = found.headers
                            revisit = h.get("warc-type") == "revisit"
                            payload = None if revisit else found.block.partition(b"\r\n\r\n")[2]
                            digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload)
                            size = number(h.get("x-payload-length")) if revisit else len(payload)
                            rows.append((path, found.offset, found.length, h.get("warc-type"), number(h.get("x-page-id")), size, digest, number(h.get("x-refers-to-page")), payload, None))
                            held += len(found.block)
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    spread = manifest.select("path").repartition(n, "path")
    return spread.mapInArrow(run, "path string, offset long, length long, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: the record columns of read_archives, without gaps.

    pages: (page_id, url, html, ...); other columns are ignored.  A null html is an empty payload, which counts as equal to
    other empty ones; a null url an empty target.  Rows that share page_id and payload are equal records.  A null page_id
    is never a response for others.  An empty table writes no archive and gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    manifest = write_archives(pages.select("page_id", "url", "html"), shared_path(spark, "warc"), min_bytes)
    return read_archives(manifest).where("record_type <> 'gap'")
