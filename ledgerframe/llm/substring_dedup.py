"""Removal of word passages that an earlier document holds as well.

Method: fixed-block anchors.  Every document is cut into non-overlapping
reference blocks of ``(window + 1) // 2`` words; any run of ``window`` words
holds one whole block, wherever it begins.  Every rolling window of a block's
length probes the block index.  Anchors that two documents share are extended to
all ``window``-word runs around them; overlapping runs that an earlier document
holds too join to maximal exact repeats, and their words go.

Scale.  Documents are written once as chunks of bounded text.  What crosses the
network is, for each chunk and hash bucket, one sorted array of distinct hashes, never
a row per window or a pair of documents: a passage that a third of all documents
share is one entry per chunk.  Anchors take 6 bytes (a false one only costs a look
around it), the runs that decide on words 14, more than 112 bits with the bucket's
number.  Answers are one bit per entry.  The number of buckets follows from the
bytes of the texts, so that one holds about ``bucket_bytes`` of keys whatever their
number; rows of the exchange are chunks times buckets, so ``chunk_bytes`` should grow
with a worker's memory (it takes about 40 times that).
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
from ._words import SPACED, U, Words, buffers, covered, pieces

_LATE = np.iinfo(np.int64).max
#: A key's low bits, which cross the network; the others name its bucket.
_BITS = 44
_LOW = U((1 << _BITS) - 1)
_MOST_BUCKETS = 1 << 64 - _BITS


def _to_chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_pydict({"chunk": [(part << 32) + k], "size": [size], "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes):
                n = len(buffers(piece.column("text"))[0])
                if held and size + n > chunk_bytes:
                    yield flush()
                    held, size, k = [], 0, k + 1
                held.append(piece)
                size += n
        if held:
            yield flush()

    return run


def _open(blob: bytes) -> tuple[np.ndarray, Words, pa.Table]:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) and ids.num_chunks else ids
    text = table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())
    return ids.fill_null(_LATE).to_numpy(zero_copy_only=False).astype(np.int64), Words(*buffers(text), SPACED, False), table


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash by its top 32 bits."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _pack(h: np.ndarray) -> bytes:
    """The low bits of sorted hashes, six bytes each."""
    return np.ascontiguousarray((h & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """The key that six bytes and a bucket number stand for."""
    return (_buckets(h, n_buckets).astype(U) << U(_BITS)) + (h & _LOW)


def _unpack(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _bits(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8), count=n).astype(bool)


def _rows(chunk: int, key: np.ndarray, n_buckets: int, columns: dict) -> pa.RecordBatch:
    """One row per bucket for sorted keys; columns: name to a function of a slice."""
    cuts = np.searchsorted(key >> U(_BITS), np.arange(n_buckets + 1, dtype=U))
    full = np.flatnonzero(np.diff(cuts))
    made = {"bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int64())}
    made |= {name: pa.array([f(slice(cuts[b], cuts[b + 1])) for b in full], pa.binary()) for name, f in columns.items()}
    return pa.RecordBatch.from_pydict(made)


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the one before."""
    first = np.ones(len(sorted_keys[0]), bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return first


class _Probes:
    """Distinct rolling windows of a chunk, which are aligned blocks, and in how many documents."""

    def __init__(self, words: Words, h: np.ndarray, ids: np.ndarray, block: int, n_buckets: int):
        at, key = words.windows(h, block, seed=1)
        key = _wide(key, n_buckets)
        row = np.repeat(np.arange(len(words.counts)), words.counts)[at] if len(at) else at
        order = np.argsort(key)
        self.at, sorted_key = at[order], key[order]
        first = np.ones(len(key), bool)
        first[1:] = sorted_key[1:] != sorted_key[:-1]
        self.key, self.group = sorted_key[first], np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        aligned = ((at - words.bounds[row]) % block == 0)[order]
        doc = ids[row][order]
        if len(starts):
            self.aligned = np.logical_or.reduceat(aligned, starts)
            low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
            self.shared = low != high
        else:
            self.aligned = self.shared = np.zeros(0, bool)


class _Runs:
    """Distinct windows of a chunk around shared anchors, with the least document of each."""

    def __init__(self, words: Words, h: np.ndarray, ids: np.ndarray, hit: np.ndarray, window: int, block: int, n_buckets: int):
        at, key = words.windows(h, window, seed=2)
        anchors = np.concatenate([[0], np.cumsum(hit)])
        near = anchors[at + window - block + 1] > anchors[at] if len(at) else np.zeros(0, bool)
        more = words.windows(h, window, seed=4)[1][near]
        at, key = at[near], _wide(key[near], n_buckets)
        row = np.repeat(np.arange(len(words.counts)), words.counts)[at] if len(at) else at
        order = np.lexsort((more, key))
        self.at, sorted_key, more = at[order], key[order], more[order]
        first = _firsts(sorted_key, more)
        self.key, self.more, self.group = sorted_key[first], more[first], np.cumsum(first) - 1
        self.doc_at = ids[row][order]
        starts = np.flatnonzero(first)
        self.doc = np.minimum.reduceat(self.doc_at, starts) if len(starts) else np.zeros(0, np.int64)


def _in_key_order(table: pa.Table, names: list[str]) -> list[list]:
    """Columns of answers as lists, by bucket."""
    order = np.argsort(np.asarray(table.column("bucket")))
    return [[table.column(n)[int(i)].as_py() for i in order] for n in names]


def _joined(answers: pa.Table, n: int) -> np.ndarray:
    """The answer bits of a chunk for its keys in order."""
    sizes, bits = _in_key_order(answers, ["n", "bits"])
    out = np.concatenate([_flags(b, k) for b, k in zip(bits, sizes, strict=True)]) if bits else np.zeros(0, bool)
    if len(out) != n:
        raise RuntimeError(f"{len(out)} answers for {n} keys of a chunk")
    return out


_PROBES = "bucket int, chunk long, keys binary, aligned binary, shared binary"
_RUNS = "bucket int, chunk long, keys binary, more binary, docs binary"
_ANSWERS = "chunk long, bucket int, n int, bits binary"


def _merge(table: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Chunks, sizes, all keys of a bucket, and which key is which distinct one."""
    keys = [_unpack(x.as_py()) for x in table.column("keys")]
    parts = [np.concatenate(keys)]
    if "more" in table.column_names:
        parts.append(np.frombuffer(b"".join(table.column("more").to_pylist()), "<u8"))
    order = np.lexsort(parts[::-1])
    first = _firsts(*(x[order] for x in parts))
    return table.column("chunk").to_pylist(), [len(k) for k in keys], order, np.flatnonzero(first), np.cumsum(first) - 1


def _answers(bucket: int, chunks: list[int], sizes: list[int], flags: np.ndarray) -> pa.Table:
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    bits = [_bits(flags[cuts[i] : cuts[i + 1]]) for i in range(len(sizes))]
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(sizes), pa.int32()), "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _docs_of(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in table.column("docs")])


def _find_anchors(table: pa.Table) -> pa.Table:
    """Keys that are an aligned block somewhere and occur in two documents or two chunks."""
    chunks, sizes, order, starts, group = _merge(table)
    aligned = np.concatenate([_flags(x.as_py(), n) for x, n in zip(table.column("aligned"), sizes, strict=True)])[order]
    shared = np.concatenate([_flags(x.as_py(), n) for x, n in zip(table.column("shared"), sizes, strict=True)])[order]
    several = np.logical_or.reduceat(shared, starts) | (np.bincount(group) > 1)
    hit = np.empty(len(order), bool)
    hit[order] = (np.logical_or.reduceat(aligned, starts) & several)[group]
    return _answers(table.column("bucket")[0].as_py(), chunks, sizes, hit)


def _find_earlier(table: pa.Table) -> pa.Table:
    """Keys of a chunk that a smaller document of another chunk holds."""
    chunks, sizes, order, starts, group = _merge(table)
    doc = _docs_of(table)
    least = np.empty(len(order), np.int64)
    least[order] = np.minimum.reduceat(doc[order], starts)[group]
    return _answers(table.column("bucket")[0].as_py(), chunks, sizes, least < doc)


def repeated_passages(docs: DataFrame, window: int = 13, chunk_bytes: int = 4 << 20, bucket_bytes: int = 32 << 20, with_text: bool = True) -> DataFrame:
    """Documents without the passages that an earlier document holds.

    ``docs`` has ``doc_id`` and ``text``.  Words are runs of characters other
    than ASCII white space, unchanged.  A word goes if a window of ``window``
    words that covers it also starts in a document with a smaller id; windows are
    judged on the input.  Returns per row doc_id, n_words, n_removed, kept_text
    (kept words joined by one space; left out without ``with_text``) and
    kept_sha256.

    Nulls: a null text has no words; null ids count as larger than every id and as
    one document.  Empty texts have no words.  Very long texts are compared whole, a
    text longer than ``chunk_bytes`` as a chunk of its own.  Ties and repeats: rows
    with equal ids are one document for the order, so a passage never goes because of
    a row with the same id.  An empty table gives no rows.  Other columns, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    held = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_to_chunks(chunk_bytes), "chunk long, size long, docs binary"), "chunks")
    size = held.agg(F.sum("size")).first()[0] or 0
    n_buckets = min(_MOST_BUCKETS, max(4 * partitions(spark), -(-size // bucket_bytes)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True):
                ids, words, _ = _open(blob.as_buffer())
                p = _Probes(words, words.hashes(), ids, block, n_buckets)
                yield _rows(chunk, p.key, n_buckets, {"keys": lambda s, p=p: _pack(p.key[s]), "aligned": lambda s, p=p: _bits(p.aligned[s]), "shared": lambda s, p=p: _bits(p.shared[s])})

    anchors = materialize(held.mapInArrow(probe, _PROBES).groupBy("bucket").applyInArrow(_find_anchors, _ANSWERS), "anchors")

    def extend(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        made = [pa.RecordBatch.from_pydict({n: pa.array([], t) for n, t in (("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()))})]
        for chunk, blob in zip(chunks.column("chunk").to_pylist(), chunks.column("docs"), strict=True):
            ids, words, _ = _open(blob.as_buffer())
            r = _runs(words, ids, answers)
            made.append(_rows(chunk, r.key, n_buckets, {"keys": lambda s, r=r: _pack(r.key[s]), "more": lambda s, r=r: r.more[s].astype("<u8").tobytes(), "docs": lambda s, r=r: zlib.compress(r.doc[s].astype("<i8").tobytes(), 1)}))
        return pa.Table.from_batches(made)

    def _runs(words: Words, ids: np.ndarray, answers: pa.Table) -> _Runs:
        h = words.hashes()
        p = _Probes(words, h, ids, block, n_buckets)
        hit = np.zeros(len(h), bool)
        hit[p.at] = _joined(answers, len(p.key))[p.group]
        return _Runs(words, h, ids, hit, window, block, n_buckets)

    earlier = materialize(held.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, _RUNS).groupBy("bucket").applyInArrow(_find_earlier, _ANSWERS), "earlier")

    def remove(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        tag = answers.column("kind").to_numpy() if len(answers) else np.zeros(0)
        one, two = answers.filter(pa.array(tag == 0)), answers.filter(pa.array(tag == 1))
        out = []
        for blob in chunks.column("docs"):
            ids, words, table = _open(blob.as_buffer())
            r = _runs(words, ids, one)
            gone = (r.doc_at > r.doc[r.group]) | _joined(two, len(r.key))[r.group] if len(r.at) else np.zeros(0, bool)
            lost = covered(len(words), r.at[gone], window)
            text = words.data.tobytes()
            b = words.bounds
            kept, texts, shas = [], [], []
            for i in range(len(ids)):
                alive = np.flatnonzero(~lost[b[i] : b[i + 1]]) + b[i]
                joined = b" ".join([text[s:e] for s, e in zip(words.starts[alive].tolist(), words.ends[alive].tolist(), strict=True)])
                kept.append(len(alive))
                texts.append(joined if with_text else b"")
                shas.append(hashlib.sha256(joined).hexdigest())
            n = words.counts
            made = {"doc_id": table.column("doc_id").cast(pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.array(kept, np.int64), pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(shas, pa.string())}
            out.append(pa.table(made if with_text else {k: v for k, v in made.items() if k != "kept_text"}))
        return pa.concat_tables(out)

    both = anchors.withColumn("kind", F.lit(0)).unionByName(earlier.withColumn("kind", F.lit(1)))
    schema = "doc_id long, n_words long, n_removed long, " + "kept_text string, " * with_text + "kept_sha256 string"
    return held.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(remove, schema)
