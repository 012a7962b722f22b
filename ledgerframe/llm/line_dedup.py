"""Removal of lines that an earlier document holds as well.

Method: hashes of lines are range-partitioned and sorted by hash, document and
position; each task streams its range once, the first occurrence of a hash
names the document that keeps it, and what goes back is which lines fall.  The
result is a compressed bitmap of kept lines for each document, not text.

Scale.  A hash (128 bits) is uniform, so its top bits name its range and no sampling pass is
needed.  Documents are written once as chunks of bounded text, and each chunk
sends a hash once, with the least document that holds it there: a line that a
third of all documents share is one row per chunk.  The stream holds one row,
whatever the number of rows of a hash.  Answers are one row for each hash of a
chunk that an earlier document elsewhere holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import materialize, partitions
from ._words import LOWER, SPACED, buffers
from .substring_dedup import _to_chunks

_LATE = np.iinfo(np.int64).max


class _Lines:
    """Lines of a chunk's texts, and the distinct keys among them with the least document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, least: int):
        breaks = np.flatnonzero(data == 0x0A)
        self.counts = np.diff(np.searchsorted(breaks, offsets)) + 1
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        # Starts and ends grow along the lines, so sorting each puts them in the lines' order.
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        self.ends = np.sort(np.concatenate([breaks, offsets[1:]]))
        visible = np.flatnonzero(SPACED[data])
        first, last = np.searchsorted(visible, self.starts), np.searchsorted(visible, self.ends) - 1
        full = np.flatnonzero(first <= last)
        start, end = visible[first[full]], visible[last[full]] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
        long_enough = points[end] - points[start] >= least
        line, start, end = full[long_enough], start[long_enough], end[long_enough]
        lowered = LOWER[data].tobytes()
        digests = [hashlib.blake2b(lowered[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        key, more = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        doc = np.repeat(ids, self.counts)[line]
        order = np.lexsort((more, key))
        self.line, key, more, self.doc = line[order], key[order], more[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        starts = np.flatnonzero(new)
        self.key, self.more, self.group = key[new], more[new], np.cumsum(new) - 1
        self.first_doc = np.minimum.reduceat(self.doc, starts) if len(starts) else self.doc

    def lost(self, elsewhere: np.ndarray) -> np.ndarray:
        """Flags by line; ``elsewhere`` numbers the keys that an earlier document of another chunk holds."""
        out = np.zeros(len(self.starts), bool)
        earlier = np.zeros(len(self.key), bool)
        earlier[elsewhere] = True
        if len(self.group):
            out[self.line[earlier[self.group] | (self.doc > self.first_doc[self.group])]] = True
        return out


def _open(blob: pa.Buffer, least: int) -> tuple[pa.Array, bytes, _Lines]:
    """Ids, text bytes and lines of a chunk."""
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    ids, text = (table.column(c).chunk(0) for c in ("doc_id", "text"))
    data, offsets = buffers(text)
    return ids, data.tobytes(), _Lines(data, offsets, ids.fill_null(_LATE).to_numpy(), least)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range whose hash an earlier document holds: the first row of a hash names that document."""
    before = None
    for batch in batches:
        if not len(batch):
            continue
        key, more, doc = (batch.column(c).to_numpy() for c in ("key", "more", "doc"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        first = doc[new][np.cumsum(new) - 1]
        if before is not None and before[:2] == (key[0], more[0]):
            stop = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(key)
            first[:stop] = before[2]
        before = key[-1], more[-1], first[-1]
        late = pa.array(np.flatnonzero(doc > first))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(late) for c in ("chunk", "k")], ["chunk", "k"])


def keep_flags(keep: bytes, n_lines: int) -> np.ndarray:
    """The bitmap of a document as one flag for each line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def first_lines(docs: DataFrame, least: int = 10, chunk_bytes: int = 4 << 20, range_bytes: int = 256 << 20, with_text: bool = False) -> DataFrame:
    """For each document, which of its lines stay when an earlier document's lines go from later ones.

    ``docs`` has ``doc_id`` and ``text``.  Lines end at ``\\n``; a line's key is the
    line without ASCII white space at both ends, A-Z lower-cased.  Keys of at least
    ``least`` code points found in two documents lose all lines except those of the
    smallest document; there all of them stay, repeats too.  Returns per row doc_id,
    n_lines, n_dropped, keep (a zlib-compressed bitmap, first line in the highest bit
    of the first byte, see ``keep_flags``), kept_sha256 and, with ``with_text``,
    kept_text (kept lines joined by ``\\n``).

    Nulls: a null text is one empty line, as an empty one is; null ids count as
    larger than every id and as one document.  Very long texts are compared whole, a
    text longer than ``chunk_bytes`` as a chunk of its own.  Ties and repeats: rows
    with equal ids are one document, so a line never goes because of a row with the
    same id.  An empty table gives no rows.  Other columns, whatever their names, are
    not read.
    """
    spark = docs.sparkSession
    held = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_to_chunks(chunk_bytes), "chunk long, size long, docs binary"), "chunks")
    size = held.agg(F.sum("size")).first()[0] or 0
    ranges = max(partitions(spark), -(-size // range_bytes))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True):
                lines = _open(blob.as_buffer(), least)[2]
                n = len(lines.key)
                yield pa.RecordBatch.from_pydict({"key": lines.key, "more": lines.more, "doc": lines.first_doc, "chunk": np.full(n, chunk), "k": np.arange(n, dtype=np.int32)})

    dealt = held.mapInArrow(keys, "key long, more long, doc long, chunk long, k int")
    in_range = F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(ranges).cast("long"), 31).cast("int")
    late = dealt.repartitionById(ranges, in_range).sortWithinPartitions("key", "more", "doc", "chunk", "k").mapInArrow(_later, "chunk long, k int")

    def mark(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        for blob in chunks.column("docs"):
            ids, text, lines = _open(blob.as_buffer(), least)
            stays = ~lines.lost(answers.column("k").to_numpy())
            keep, texts, shas = [], [], []
            for at, to in zip(lines.bounds[:-1].tolist(), lines.bounds[1:].tolist(), strict=True):
                kept = np.flatnonzero(stays[at:to]) + at
                joined = b"\n".join([text[s:e] for s, e in zip(lines.starts[kept].tolist(), lines.ends[kept].tolist(), strict=True)])
                keep.append(zlib.compress(np.packbits(stays[at:to]).tobytes(), 1))
                shas.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined)
            dropped = np.add.reduceat((~stays).astype(np.int64), lines.bounds[:-1])
            columns = {"doc_id": ids, "n_lines": pa.array(lines.counts, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "keep": pa.array(keep, pa.binary()), "kept_sha256": pa.array(shas, pa.string())}
            made.append(pa.table(columns | ({"kept_text": pa.array(texts, pa.binary()).cast(pa.string())} if with_text else {})))
        return pa.concat_tables(made)

    schema = "doc_id long, n_lines long, n_dropped long, keep binary, kept_sha256 string" + ", kept_text string" * with_text
    return held.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(mark, schema)
