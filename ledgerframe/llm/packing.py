"""Packing of tokenized documents into sequences of bounded length, best-two-fit.

Method.  Bins are filled greedily: the longest unpacked piece first, then always
the longest that still fits.  A bin with a gap then gives up its smallest document
for two unpacked documents that fit the expanded gap more tightly.

Scale.  Which documents of one length go where is immaterial, so bins are made on
the histogram of lengths: at most ``capacity`` counts come to the driver, however
many documents there are.  A bin's pattern is repeated as often as the counts
allow, and each repetition uses up a length or leaves fewer of it than one pattern
needs, so the number of patterns is bounded by the capacity and not by the corpus.
Documents then take their places by their rank among documents of equal length.
Ranks are counted in salted groups, so a length that a third of all documents share
is no single group.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import materialize, partitions

CAPACITY = 2048


class _Left:
    """Counts of unpacked pieces by length, with the longest present up to a limit."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.present = np.flatnonzero(counts)

    def longest(self, limit: int) -> int:
        k = int(np.searchsorted(self.present, limit, "right"))
        return int(self.present[k - 1]) if k else 0

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.present = self.present[self.present != length]

    def give(self, length: int, n: int) -> None:
        if not self.counts[length]:
            self.present = np.insert(self.present, np.searchsorted(self.present, length), length)
        self.counts[length] += n

    def best_two(self, limit: int) -> tuple[int, int]:
        """Two present lengths with the largest sum within the limit, or zeros."""
        x = self.present[self.present < limit]
        if not len(x):
            return 0, 0
        k = np.searchsorted(x, limit - x, "right") - 1
        # A length pairs with itself only if two pieces have it.
        alone = (k >= 0) & (x[k] == x) & (self.counts[x] < 2)
        k = np.where(alone, k - 1, k)
        total = np.where(k >= 0, x + x[k], 0)
        best = int(np.argmax(total))
        return (int(x[best]), int(x[k[best]])) if total[best] else (0, 0)


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths) of bins that hold all pieces counted by length."""
    left, out = _Left(counts.astype(np.int64).copy()), []
    while len(left.present):
        bin_, room = [], capacity
        while length := left.longest(room):
            n = min(int(left.counts[length]), room // length)
            bin_ += [length] * n
            room -= length * n
            left.take(length, n)
        most = Counter(bin_)
        while room and len(bin_) > 1:
            small = bin_[-1]
            a, b = left.best_two(room + small)
            if a + b <= small:
                break
            bin_.pop()
            left.take(a, 1)
            left.take(b, 1)
            left.give(small, 1)
            bin_ = sorted([*bin_, a, b], reverse=True)
            room -= a + b - small
            most |= Counter(bin_)
        # Packing one bin at a time would make this bin again while as much of each length is left as it once held.
        used = Counter(bin_)
        times = 1 + max(0, min((int(left.counts[x]) + k - most[x]) // k for x, k in used.items()))
        if times > 1:
            for length, k in used.items():
                left.take(length, k * (times - 1))
        out.append((times, bin_))
    return out


def places(made: list[tuple[int, list[int]]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count per bin, first bin, offset in the bin), by length and rank."""
    ranks = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for times, bin_ in made:
        at = 0
        for length, k in zip(*(x.tolist() for x in np.unique(bin_, return_counts=True)), strict=True):
            rows.append((length, ranks[length], k, first, at))
            ranks[length] += k * times
            at += length * k
        first += times
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _tokenizer(vocabulary: str | None, tokenizer: str | None):
    """The ids of a text as the tokenizers file gives them without a template.

    Its added tokens (``<|endoftext|>``) stand for themselves wherever their strings
    occur in a text, as that library has it by default.  The ids between them come from
    the tiktoken file, which holds the same vocabulary.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def _cut(capacity: int, vocabulary: str | None, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(vocabulary, tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                ids = np.append(tokens(text.as_py() or ""), 0).astype("<u4")
                n = len(ids)
                cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for column, x in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b]), row), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, tokenizer: str | None = None, salt: int | None = None) -> DataFrame:
    """A place in a sequence of at most ``capacity`` tokens for every piece of every document.

    ``docs`` has ``doc_id`` and ``text``.  A document is its ids by the byte-level
    BPE, the strings of the tokenizer's special tokens included, then id 0.  Only longer documents are cut, so
    that all pieces but the first have ``capacity`` tokens.  Returns doc_id, piece,
    start, length, ids_crc32, sequence_id and offset; the pieces of a sequence leave
    no gap.  ``vocabulary`` and ``tokenizer`` are the paths of the tiktoken and the
    tokenizers file.

    Nulls: a null text is the empty text, one piece of id 0; a null id stays null.
    Empty texts are one piece of id 0, very long ones are cut as above.  Ties: pieces
    of one length take its places in an order of their hashes.  Rows that repeat an id
    are packed each for itself.  An empty table packs to no rows.  Other columns of
    ``docs``, whatever their names, are not read.
    """
    salt = salt or partitions(docs.sparkSession, 64)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = narrow.mapInArrow(_cut(capacity, vocabulary, tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    # Equal rows of a group are interchangeable, so a rank needs no order among them.
    cut = materialize(cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(salt))), "pieces")
    groups = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = np.zeros(capacity + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("rank", rank).join(groups.select("length", "part", "before"), ["length", "part"])
    table = docs.sparkSession.sparkContext.broadcast(places(patterns(counts, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = (t[:, 0] << 50) + t[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            r = t[np.searchsorted(key, (length << 50) + rank, "right") - 1] if len(batch) else np.zeros((0, 5), np.int64)
            within = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(r[:, 3] + within // np.maximum(r[:, 2], 1)), pa.array(r[:, 4] + within % np.maximum(r[:, 2], 1) * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
