"""Document quality by attention-based multiple-instance learning.

Method (Ilse et al., "Attention-based Deep Multiple Instance Learning", 2018).  A
document is a bag of passages of ``PASSAGE`` words, the whole text.  Every passage
is encoded: shape statistics of its bytes and words and hashed words, through a
learned tanh layer.  Gated attention weights ``softmax(w . (tanh(V h) * sigmoid(U h)))``
are learned from the documents' labels, and a logistic output scores the weighted
passage representation.

The classifier is fit on a bounded sample of labelled documents (``sample_docs`` of
them, ``sample_chars`` characters of each);
scoring is one pass over all documents without a shuffle, with a model of some
hundred kilobytes.  Inputs of a score are the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import carried, fields_of
from ._words import SPACED, U, Words, buffers, pieces

PASSAGE = 64
HASHED = 1 << 11
HIDDEN, GATE, WORD = 24, 12, 8
N_STATS = 18

# Byte classes: lower, upper, digit, beyond ASCII, sentence marks, other marks, line ends.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 3
_CLASS[list(b".,;:'\"-()?")], _CLASS[[0x0A, 0x0D]], _CLASS[[0x20, 0x09]] = 4, 6, 7
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 5


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, and the text it belongs to."""
    n = -(-w.counts // PASSAGE)
    doc = np.repeat(np.arange(len(w.counts)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return w.bounds[doc] + within * PASSAGE, doc


def encode(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passage statistics, word buckets, first words and documents of passages."""
    first, doc = passages(w)
    if not len(first):
        return np.zeros((0, N_STATS), np.float32), np.zeros(0, np.int64), first, doc
    begin = w.starts[first]
    kind = _CLASS[w.data]
    packed = np.zeros(8, U)
    counts = np.zeros((len(first), 7))
    for part in ((0, 1, 2), (3, 4, 5), (6,)):
        lut = packed.copy()
        for j, c in enumerate(part):
            lut[c] = U(1) << U(21 * j)
        total = np.add.reduceat(lut[kind], begin)
        for j, c in enumerate(part):
            counts[:, c] = total >> U(21 * j) & U((1 << 21) - 1)
    n_words = np.diff(np.append(first, len(w)))
    size = np.maximum(np.diff(np.append(begin, len(w.data))), 1)
    h = w.hashes()
    length = w.ends - w.starts
    mean = np.add.reduceat(length, first) / n_words
    square = np.add.reduceat(length.astype(float) ** 2, first) / n_words
    last = w.data[w.ends - 1]
    ends = np.add.reduceat((_CLASS[last] == 5).astype(float), first) / n_words
    stops = np.add.reduceat((last == 0x2E).astype(float), first) / n_words
    marks = np.add.reduceat((length == 1) & (_CLASS[w.data[w.starts]] >= 4), first, dtype=float) / n_words
    passage = np.repeat(np.arange(len(first)), n_words)
    key = (passage.astype(U) << U(40)) | (h >> U(24))
    key.sort()
    distinct = np.bincount((key >> U(40)).astype(np.int64)[np.concatenate([[True], key[1:] != key[:-1]])], minlength=len(first)) / n_words
    # Share of a document's passages that repeat another one word for word.
    ident = np.add.reduceat(h, first) ^ n_words.astype(U)
    _, inverse, copies = np.unique(np.stack([doc.astype(U), ident]), axis=1, return_inverse=True, return_counts=True)
    repeated = (copies[inverse.ravel()] > 1).astype(float)
    bag = np.log1p(w.counts[doc]) / 8
    stats = np.stack([*(counts[:, c] / size for c in range(7)), np.log1p(n_words) / 5, mean / 8, np.sqrt(np.maximum(square - mean**2, 0)) / 8, ends, stops, marks, distinct, repeated, bag, (counts[:, 5] > 0), counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)], axis=1)
    return stats.astype(np.float32), (h >> U(53)).astype(np.int64), first, doc


class Model:
    """Weights of encoder, attention and output."""

    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray, empty: float):
        self.p, self.mean, self.scale, self.empty = p, mean, scale, empty

    def score(self, w: Words) -> np.ndarray:
        stats, bucket, first, doc = encode(w)
        out = np.full(len(w.counts), self.empty)
        if len(first):
            words = np.add.reduceat(self.p["E"].astype(np.float32)[bucket], first) / np.diff(np.append(first, len(w)))[:, None]
            z = _forward(self.p, (stats - self.mean) / self.scale, words, doc, len(w.counts))[-1]
            full = w.counts > 0
            out[full] = 1 / (1 + np.exp(-z[full]))
        return out


def _forward(p: dict, stats: np.ndarray, words: np.ndarray, doc: np.ndarray, n: int):
    x = np.concatenate([stats, words], axis=1)
    h = np.tanh(x @ p["W"] + p["b"])
    tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    a = (tv * su) @ p["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, a)
    e = np.exp(a - top[doc])
    total = np.bincount(doc, weights=e, minlength=n)
    alpha = e / total[doc]
    bag = np.zeros((n, h.shape[1]))
    np.add.at(bag, doc, alpha[:, None] * h)
    return x, h, tv, su, alpha, bag, bag @ p["o"] + p["c"]


def _encoded(texts: list[str], step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, word buckets, first words and documents of all passages, and words by text; some texts at a time."""
    parts, words = [], 0
    for at in range(0, len(texts), step):
        w = Words(*buffers(pa.array(texts[at : at + step], pa.large_string())), SPACED, False)
        stats, bucket, first, doc = encode(w)
        parts.append((stats, bucket.astype(np.uint16), first + words, doc + at, w.counts))
        words += len(w)
    if not parts:
        return np.zeros((0, N_STATS), np.float32), np.zeros(0, np.uint16), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def slopes(p: dict, stats: np.ndarray, bucket: np.ndarray, n_words: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of bags of passages and its gradient.

    ``bucket`` holds the passages' words one after the other, ``n_words`` of each.
    """
    avg = np.add.reduceat(p["E"][bucket], np.cumsum(n_words) - n_words) / n_words[:, None]
    x, h, tv, su, alpha, bag, z = _forward(p, stats, avg, doc, len(labels))
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    dz = (1 / (1 + np.exp(-z)) - labels) / len(labels)
    g = {"o": bag.T @ dz, "c": dz.sum()}
    dbag = dz[:, None] * p["o"]
    dh = alpha[:, None] * dbag[doc]
    dalpha = (h * dbag[doc]).sum(axis=1)
    da = alpha * (dalpha - np.bincount(doc, weights=alpha * dalpha, minlength=len(labels))[doc])
    g["w"] = (tv * su).T @ da
    dg = da[:, None] * p["w"]
    dtv, dsu = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
    g["V"], g["U"] = h.T @ dtv, h.T @ dsu
    dh += dtv @ p["V"].T + dsu @ p["U"].T
    dpre = dh * (1 - h**2)
    g["W"], g["b"] = x.T @ dpre, dpre.sum(axis=0)
    davg = (dpre @ p["W"].T)[:, N_STATS:] / n_words[:, None]
    g["E"] = np.stack([np.bincount(bucket, weights=np.repeat(davg[:, j], n_words), minlength=HASHED) for j in range(WORD)], axis=1)
    return loss, g


def fit(texts: list[str], labels: list[int], epochs: int = 30, seed: int = 5, penalty: float = 1e-4, rate: float = 0.01, batch: int = 256) -> Model:
    """Learn encoder, gated attention and output together by Adam on the log loss."""
    labels = np.array(labels, float)
    prior = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    stats, bucket, first, doc, counts = _encoded(texts)
    empties = labels[counts == 0] if len(labels) else labels
    empty = float((empties.sum() + 2 * prior) / (len(empties) + 2))
    mean, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-3) if len(first) else (np.zeros(N_STATS), np.ones(N_STATS))
    stats = (stats - mean) / scale
    r = np.random.default_rng(seed)
    d = N_STATS + WORD
    p = {"E": r.normal(0, 0.1, (HASHED, WORD)), "W": r.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": r.normal(0, GATE**-0.5, GATE), "o": np.zeros(HIDDEN), "c": np.array(np.log(prior / (1 - prior)))}
    if not len(first):
        return Model(p, mean, scale, empty)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    n_words = np.diff(np.append(first, len(bucket)))
    docs = np.flatnonzero(counts > 0)
    low, high = np.searchsorted(doc, np.arange(len(counts))), np.searchsorted(doc, np.arange(len(counts)), "right")
    step = 0
    for _ in range(epochs):
        r.shuffle(docs)
        for at in range(0, len(docs), batch):
            own = docs[at : at + batch]
            k = np.concatenate([np.arange(low[i], high[i]) for i in own])
            d_k = np.repeat(np.arange(len(own)), high[own] - low[own])
            words_k = np.concatenate([np.arange(first[i], first[i] + n_words[i]) for i in k])
            _, g = slopes(p, stats[k], bucket[words_k], n_words[k], d_k, labels[own])
            step += 1
            for name, v in p.items():
                q = g[name] + penalty * v
                m1[name] = 0.9 * m1[name] + 0.1 * q
                m2[name] = 0.999 * m2[name] + 0.001 * q * q
                p[name] = v - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
    return Model(p, mean, scale, empty)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_chars: int = 20_000, label: str = "quality") -> Model:
    """A model from a bounded sample of labelled documents that are not held out.

    The sample is the ``sample_docs`` labelled documents whose id hashes least; of a
    text of more than ``sample_chars`` characters it has sixteen stretches, spread
    evenly from its first word to its last, of ``sample_chars`` in all.  Labels that
    are null or not 0 or 1 are left out, of repeated labels of one document the least
    counts, of repeated documents the least text.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"))
    known = known.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_docs)
    # The sample is bounded by sample_docs rows of three numbers.
    n, width = F.char_length("text"), sample_chars // 16
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring(F.col("text"), (F.floor((n - width) * i / 15) + 1).cast("int"), F.lit(width))), "\n")
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    drawn = drawn.withColumn("text", F.when(n > sample_chars, spread).otherwise(F.col("text")))
    rows = drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).orderBy("doc_id").collect()
    return fit([r.text for r in rows], [r.label for r in rows])


def _score(model, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for piece in pieces(batch, "text", shard_bytes):
                s = m.score(Words(*buffers(piece.column("text")), SPACED, False))
                kept = [c for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(s, pa.float64())], [*kept, "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None, carry: list[str] | None = None, threshold: float = 0.3, shard_bytes: int = 4 << 20) -> DataFrame:
    """A quality score for every whole text.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and
    ``quality``.  Returns per row doc_id, carried (a struct of the columns of ``docs``
    named by ``carry``, if any), held_out, score (0 to 1, higher: label 1 likelier)
    and predicted (1 if the score reaches the threshold).

    Nulls: a null text is the empty text; a null id is not held out; a null label is
    none.  Empty texts, and texts of white space, have the smoothed rate of label 1
    among such texts of the sample.  Very long texts are scored whole.  Ties and
    repeats: rows that repeat an id are scored each for itself, equal texts alike.
    Empty tables: without labels the score is 0.5, no documents give no rows.  Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or train(docs, labels))
    head = docs.select("doc_id", *carried(docs, carry))
    rows = docs.select("doc_id", *carried(docs, carry), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(sent, shard_bytes), fields_of(head, "score double"))
    return scored.select(*head.columns, F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
