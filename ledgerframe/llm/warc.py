"""WARC archives of pages: a writer, and a reader that salvages damaged files.

Writer.  Archives are real ``.warc`` byte streams written by Spark's own text
writer: a row is one record, and the line separator is the CR LF CR LF that ends
a record (with ``gzip_members`` a row is one gzip member, and the separator is an
empty member).  So archives can lie in any store Spark writes to, and a lost
task's files are never seen.  Equal payloads are stored once; the later pages are
revisit records.

Reader.  Records are checked as they come: version line, header, block length,
end mark, digest.  After a failed check the reader searches for the next valid
gzip member or version line, goes on from there, and logs the bytes between as a
quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import materialize, temporary_path

END = b"\r\n\r\n"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Broadcast the table of revisits (48 bytes a row) up to so many rows, join by shuffle beyond.
_BROADCAST_ROWS = 100_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record without its end mark."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{sha}')}>")]
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def _records(gzip_members: bool, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")]
            out = [record(i, u, h.as_buffer().to_pybytes() if h.is_valid else b"", r, date) for i, u, r, h in zip(*columns, batch.column("html"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([_gzip(x + END) for x in out] if gzip_members else out, pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, records_per_file: int = 5000, gzip_members: bool = False, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 128 << 20) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives below ``path``.

    The payload is the html in UTF-8, null as no bytes.  Of rows with equal
    payloads those with the least page_id (rows that repeat it included) are
    responses, the others revisit it; null ids come last.

    An archive holds at most ``records_per_file`` records and, unless it is of one
    record, about ``file_bytes``: pages are written by size, each doubling in a pass
    of its own with half the records.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    weight = F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)) + F.lit(1024.0)
    level = F.least(F.greatest(F.ceil(F.log2(weight * records_per_file / file_bytes)), F.lit(0)), F.lit(records_per_file.bit_length())).cast("int")
    pages = pages.withColumn("level", level)
    levels = sorted(r.level for r in pages.select("level").distinct().collect()) or [0]
    seen = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"))
    first = seen.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("n"), F.count("page_id").alias("known"))
    first = materialize(first.filter("n > 1 AND known > 0 AND (last > refers_to OR known < n)").select("sha", "refers_to"), "first")
    n = first.count()
    if n == 0:
        marked = pages.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        joined = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(F.broadcast(first) if n <= _BROADCAST_ROWS else first, "sha", "left")
        marked = joined.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to")), F.col("refers_to")))
    for i, at in enumerate(levels):
        part = marked if len(levels) == 1 else marked.filter(F.col("level") == at)
        rows = part.select("page_id", "url", "html", "refers_to").mapInArrow(_records(gzip_members, date), "value binary")
        writer = rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", max(1, records_per_file >> at))
        if gzip_members:
            writer = writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        else:
            writer = writer.option("lineSep", END.decode())
        (writer.mode("append") if i else writer).text(path)


@dataclass
class Salvage:
    """What a reader finds in one archive: records, and gaps as (begin, end, why)."""

    records: list[tuple[int, dict[str, str], bytes]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _one(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Header, block and end of the record that begins at a place, or what is wrong."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    stop = data.find(END, at)
    if stop < 0:
        return "no end of header"
    header = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        header[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if any(not header.get(k) for k in ("warc-type", "warc-record-id", "warc-date")):
        return "missing header field"
    length = header.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return "bad content length"
    begin = stop + len(END)
    end = begin + int(length)
    if data[end : end + len(END)] != END:
        return "no end mark"
    block = data[begin:end]
    claimed = header.get("warc-block-digest", "")
    if claimed and claimed.removeprefix("sha1:").upper() != digest(block):
        return "block digest differs"
    return header, block, end + len(END)


def _plain(data: bytes, out: Salvage, base: int | None = None) -> None:
    at, bad, why = 0, -1, ""
    while at < len(data):
        got = _one(data, at)
        if not isinstance(got, str):
            if bad >= 0:
                out.gaps.append((bad if base is None else base, at if base is None else base, why))
                bad = -1
            out.records.append((at if base is None else base, got[0], got[1]))
            at = got[2]
            continue
        if bad < 0:
            bad, why = at, got
        following = VERSION.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad >= 0:
        out.gaps.append((bad if base is None else base, len(data) if base is None else base, why))


def _inflated(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes | None, int]:
    """Content and end of the gzip member that begins at a place, or None; fed in steps, so no rest is copied."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        return None, at
    z, out = zlib.decompressobj(31), []
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(data[at : at + step]))
            at += step
    except zlib.error:
        return None, at
    return (b"".join(out), min(at, len(data)) - len(z.unused_data)) if z.eof else (None, at)


def _members(data: bytes, out: Salvage) -> None:
    at, bad, why = 0, -1, ""
    while at < len(data):
        plain, end = _inflated(data, at)
        inner = Salvage()
        if plain is not None:
            _plain(plain, inner, at)
        if plain is None or inner.gaps and not inner.records:
            if bad < 0:
                bad, why = at, "bad gzip member" if plain is None else inner.gaps[0][2]
            following = data.find(b"\x1f\x8b\x08", at + 1)
            at = following if following >= 0 else len(data)
            continue
        if bad >= 0:
            out.gaps.append((bad, at, why))
            bad = -1
        out.records += inner.records
        out.gaps += [(at, end, reason) for _, _, reason in inner.gaps]
        at = end
    if bad >= 0:
        out.gaps.append((bad, len(data), why))


def salvage(data: bytes) -> Salvage:
    """All records that can be had from an archive, plain or of gzip members."""
    out = Salvage()
    _members(data, out) if data[:2] == b"\x1f\x8b" or (VERSION.match(data) is None and b"\x1f\x8b\x08" in data and VERSION.search(data) is None) else _plain(data, out)
    return out


_READ = "archive string, begin long, gap_end long, gap_reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(with_payload: bool):
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = salvage(content.as_buffer().to_pybytes())
                rows = []
                for at, header, block in found.records:
                    kind = header.get("warc-type", "")
                    head, _, payload = block.partition(END)
                    sha = digest(payload)
                    claimed = header.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "response" and claimed and claimed != sha:
                        found.gaps.append((at, at, "payload digest differs"))
                        continue
                    full = kind == "response"
                    number = lambda k, h=header: int(h[k]) if re.fullmatch(r"-?[0-9]+", h.get(k, "")) else None
                    rows.append((path, at, None, None, number("x-page-id"), header.get("warc-target-uri"), len(payload) if full else number("x-payload-length"), sha if full else claimed, kind, number("x-refers-to-page-id"), payload if with_payload and full else None))
                rows += [(path, a, b, why, None, None, None, None, None, None, None) for a, b, why in found.gaps]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives below a path, and quarantined gaps.

    A gap is a row with ``gap_reason``: the bytes from ``begin`` to ``gap_end`` of
    ``archive`` hold no valid record.  Revisit records have the payload's digest
    and length and no payload.  An empty archive has no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), _READ)


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write pages to archives and read them back: the records, one for each row of ``pages``.

    A gap in these archives, just written, fails the job: a page would be missing.

    Nulls: a null html is no bytes, a null url about:blank; a null id stays null and
    comes last.  Empty and very long pages are records like others; an archive of one
    long page may pass ``file_bytes``.  Ties and repeats: of equal payloads those with
    the least page_id are responses, rows that repeat it included.  An empty table
    gives no rows.  Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    path = path or temporary_path(spark, "warc")
    write_archives(pages, path, **options)
    gap = F.concat(F.lit("archive_damaged:"), "archive", F.lit(":"), "gap_reason")
    return read_archives(spark, path, with_payload=False).filter(F.when(F.col("gap_reason").isNull(), True).otherwise(F.raise_error(gap).cast("boolean")))
