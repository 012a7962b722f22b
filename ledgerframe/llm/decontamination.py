"""Benchmark passages in training documents, by an FM-index per training shard.

Method.  A shard of documents is a text of symbols, one per benchmark word; other
words and document ends are separators, and a run of symbols that is shorter than
every phrase cannot hold one and is left out.  The shard's FM-index is searched
backwards for all phrases at once through wavelet-tree ranks; occurrences are
located by sampled suffix positions and merged to removal spans.

Scale.  One pass over the documents without a shuffle.  The benchmark's phrases
are broadcast in blocks: their table takes four bytes a word of each window, and a
benchmark whose table exceeds ``block_bytes`` takes several passes, by items, in
which spans and items travel along with their document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import carried, fields_of
from ._words import ALNUM, Words, buffers, covered, pieces
from .fm_index import FMIndex


@dataclass
class Phrases:
    """Distinct phrases of a block of items, by length, and the items of each."""

    vocabulary: np.ndarray  # sorted word hashes; a word's symbol is its place + 1
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # symbols, item bounds, items
    items: list[str]

    @property
    def least(self) -> int:
        return min(self.by_length, default=0)


def phrases(ids: list, texts: list, window: int) -> Phrases:
    """Windows of ``window`` words of each text; a shorter text is one phrase."""
    w = Words(*buffers(pa.array(texts, pa.large_string())), ALNUM, True)
    vocabulary, symbol = np.unique(w.hashes(), return_inverse=True)
    symbol = (symbol.ravel() + 1).astype(np.int32)
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    names = sorted({str(i) for i in ids})
    number = {name: k for k, name in enumerate(names)}
    for i, name in enumerate(ids):
        words = symbol[w.bounds[i] : w.bounds[i + 1]]
        n = min(window, len(words))
        if n:
            found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(words, n), number[str(name)]))
    by_length = {}
    for n, parts in found.items():
        every = np.concatenate([p for p, _ in parts])
        item = np.concatenate([np.full(len(p), k, np.int32) for p, k in parts])
        distinct, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), item]), axis=1)
        by_length[n] = distinct, np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), pairs[1]
    return Phrases(vocabulary, by_length, names)


def occurrences(words: Words, p: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each phrase length: length, phrase numbers, first words; item bounds and items."""
    if not len(words) or not p.by_length:
        return
    h = words.hashes()
    place = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    known = p.vocabulary[place] == h
    # Runs of benchmark words inside one document that are long enough for a phrase.
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    edge = words.bounds[:-1][words.counts > 0]
    begin[edge] = known[edge]
    start = np.flatnonzero(begin)
    run = np.cumsum(begin) - 1
    size = np.bincount(run[known], minlength=len(start))
    use = size >= p.least
    member = known & use[np.maximum(run, 0)] if len(start) else known
    if not member.any():
        return
    at = np.flatnonzero(member)
    new = begin[at]
    to = np.arange(len(at)) + np.cumsum(new)
    text = np.zeros(to[-1] + 2, np.int64)
    text[to] = place[at] + 1
    back = np.zeros(len(text), np.int64)
    back[to] = at
    index = FMIndex(text, len(p.vocabulary))
    for n, (symbols, bounds, items) in p.by_length.items():
        which, low, high = index.search(symbols)
        if len(which):
            count = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
            yield n, np.repeat(which, count), back[index.locate(rows)], bounds, items


def _search(block, finish: bool, shard_bytes: int, with_text: bool, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = block.value
        for batch in batches:
            for piece in pieces(batch, "_text", shard_bytes):
                words = Words(*buffers(piece.column("_text")), ALNUM, True)
                n_docs = len(piece)
                row = np.repeat(np.arange(n_docs), words.counts)
                hit = np.zeros(len(words), bool)
                pairs = [np.zeros((2, 0), np.int64)]
                for n, which, first, bounds, items in occurrences(words, p):
                    hit |= covered(len(words), first, n)
                    seen = np.unique(np.stack([row[first], which]), axis=1)
                    many = np.diff(bounds)[seen[1]]
                    k = np.repeat(bounds[seen[1]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
                    pairs.append(np.stack([np.repeat(seen[0], many), items[k]]))
                pair = np.unique(np.concatenate(pairs, axis=1), axis=1)
                cut = np.searchsorted(pair[0], np.arange(n_docs + 1))
                names = [[p.items[k] for k in pair[1, a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                b = words.bounds
                for i, (earlier, old) in enumerate(zip(piece.column("_hits").to_pylist(), piece.column("_items").to_pylist(), strict=True)):
                    if earlier is not None:
                        hit[b[i] : b[i + 1]] |= np.unpackbits(np.frombuffer(earlier, np.uint8), count=int(words.counts[i])).astype(bool)
                        names[i] = sorted({*names[i], *old})
                if not finish:
                    marks = [np.packbits(hit[b[i] : b[i + 1]]).tobytes() for i in range(n_docs)]
                    yield pa.RecordBatch.from_pydict({**{c: piece.column(c) for c in kept}, "_text": piece.column("_text"), "_hits": pa.array(marks, pa.binary()), "_items": pa.array(names, pa.list_(pa.string()))})
                    continue
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[b[1:]] - total[b[:-1]]
                made = {
                    **{c: piece.column(c) for c in kept},
                    "n_words": pa.array(words.counts, pa.int64()),
                    "n_hit": pa.array(n_hit, pa.int64()),
                    "n_items": pa.array([len(x) for x in names], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names], pa.string()),
                    "contaminated": pa.array(n_hit > 0, pa.bool_()),
                }
                if with_text:
                    made["clean_text"] = _without(piece.column("_text"), words, hit, n_hit)
                yield pa.RecordBatch.from_pydict(made)

    return run


def _without(text: pa.Array, words: Words, hit: np.ndarray, n_hit: np.ndarray) -> pa.Array:
    """Texts without their removal spans, from a span's first word to its last."""
    out = []
    for i, t in enumerate(text):
        if not n_hit[i]:
            out.append(t.as_py())
            continue
        raw, (a, b), base = t.as_buffer().to_pybytes(), words.bounds[i : i + 2], int(words.offsets[i])
        h = hit[a:b]
        edge = np.diff(np.concatenate([[0], h.astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edge == 1) + a, np.flatnonzero(edge == -1) + a - 1
        kept, at = [], 0
        for x, y in zip(begins, ends, strict=True):
            kept.append(raw[at : int(words.starts[x]) - base])
            at = int(words.ends[y]) - base
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20, shard_bytes: int = 4 << 20, with_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Which words of each document lie in a passage of the benchmark.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and
    ``text``.  A-Z are lower-cased; words are runs of digits, letters a-z and
    characters beyond ASCII.  A phrase is ``window`` consecutive words of an item,
    or all words of an item with fewer.  Returns per row doc_id, carried (a struct of
    the columns of ``docs`` named by ``carry``, if any), n_words, n_hit (words inside
    an occurrence), n_items and items_sha256 (items with an occurrence),
    contaminated, and with ``with_text`` clean_text: the text without its removal
    spans.

    Nulls: a null text has no words and stays null in clean_text; items with a null id
    or text have no phrases.  Empty texts have no words.  Very long texts are searched
    whole, a text longer than ``shard_bytes`` as a shard of its own.  Ties and repeats:
    rows that repeat an id are judged each for itself, items that repeat an id count
    once.  Empty tables: an empty benchmark hits nothing, no documents give no rows.
    Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    n = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    size = items.agg(F.sum(F.greatest(n - window + 1, F.lit(1)) * (4 * F.least(n, F.lit(window)) + 16) + F.octet_length("item_id") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    head = docs.select("doc_id", *carried(docs, carry))
    out = docs.select("doc_id", *carried(docs, carry), F.col("text").cast("string").alias("_text"), F.lit(None).cast("binary").alias("_hits"), F.lit(None).cast("array<string>").alias("_items"))
    for k in range(blocks):
        # Items of at most about block_bytes of phrases come to the driver and are broadcast at a time.
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast(phrases([r.item_id for r in rows], [r.text for r in rows], window))
        last = k == blocks - 1
        made = ["n_words long", "n_hit long", "n_items long", "items_sha256 string", "contaminated boolean", *["clean_text string"] * with_text] if last else ["_text string", "_hits binary", "_items array<string>"]
        out = out.mapInArrow(_search(sent, last, shard_bytes, with_text, head.columns), fields_of(head, *made))
    return out
