"""Phrases whose words occur together far more often than their parts do elsewhere.

Method: contiguous pattern growth in the manner of PrefixSpan.  Frequent words are
counted and numbered; every occurrence of a frequent word with a frequent next one
becomes a pointer with the words that follow it (the projection on that prefix); one
task per prefix grows it to the right, depth first: its pointers are sorted by
the words that follow, so a node of the prefix tree is a stretch of rows, closed
when its prefix ends, and a stream with one open node per depth is the recursion.

Scale.  The texts are written once as chunks; word numbers come to a chunk by a join
on the distinct words it holds, never as a broadcast dictionary.  Equal pointers of a
chunk are one row with a count, so a passage that many documents share stays small.
A prefix's task is bounded: a prefix of words that all occur more often than a fair share
of a task is dealt on by its next word, down to all four; counts of such prefixes,
which then lie in several tasks, are summed afterwards.  A task holds a batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import discard, materialize, partitions
from ._words import U, Words, buffers, mix
from .substring_dedup import _to_chunks

#: Most words of a phrase.
DEPTH = 4
#: Words of a chunk whose pointers are sorted at a time.
_STRETCH = 1 << 18
_PATH = [f"w{i}" for i in range(1, DEPTH + 1)]
_ENDS = np.zeros(256, np.int64)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = 1
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09]] = False
_WORD[_ENDS == 1] = False


def _lang_hash(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class _Pieces:
    """Words of a chunk, their keys by language, and the number of the piece each stands in."""

    def __init__(self, blob: pa.Buffer):
        table = pa.ipc.open_stream(blob).read_all().combine_chunks()
        lang = table.column("lang").chunk(0).dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.words = w = Words(*buffers(table.column("text").chunk(0)), _WORD, True)
        text = np.repeat(np.arange(len(w.counts)), w.counts)
        self.lang = lang.indices.to_numpy()[text]
        self.key = mix(w.hashes() ^ np.array([_lang_hash(x) for x in self.langs], U)[self.lang])
        self.piece = np.cumsum(_ENDS[w.data])[w.starts] + text if len(w) else text

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, a place of each, and how often it occurs."""
        return np.unique(self.key, return_index=True, return_counts=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each chunk with their counts; a null word has the number of all words of a language."""
    for batch in batches:
        for blob in batch.column("docs"):
            p = _Pieces(blob.as_buffer())
            _, at, n = p.distinct()
            text, w = p.words.data.tobytes(), p.words
            words = [text[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
            langs, totals = p.lang[at], np.bincount(p.lang, minlength=len(p.langs))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(p.langs, pa.string()).take(pa.array(np.concatenate([langs, np.arange(len(p.langs))]))),
                "word": pa.array([*words, *[None] * len(p.langs)], pa.binary()).cast(pa.string()),
                "n": np.concatenate([n, totals]).astype(np.int64),
            })


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the key that chunks give a word."""
    for batch in batches:
        data, offsets = buffers(batch.column("word"))
        key = Words(data, offsets, np.ones(256, bool), False).hashes()
        key = mix(key ^ np.array([_lang_hash(x) for x in batch.column("lang").to_pylist()], U)) if len(key) else key
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "key"])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True):
            key = _Pieces(blob.as_buffer()).distinct()[0]
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(key), chunk), "k": np.arange(len(key), dtype=np.int32), "key": key.view(np.int64)})


def _encode(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk as numbers of frequent words, 0 wherever a phrase cannot go on."""
    out = []
    for blob in chunks.column("docs"):
        p = _Pieces(blob.as_buffer())
        keys, place = np.unique(p.key, return_inverse=True)
        code = np.zeros(len(keys), np.int64)
        code[answers.column("k").to_numpy()] = answers.column("code").to_numpy()
        breaks = np.flatnonzero(p.piece[1:] != p.piece[:-1]) + 1
        out.append(np.insert(code[place], breaks, 0))
    return pa.table({"codes": pa.array(out, pa.list_(pa.int64()))})


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pointers of a chunk: a frequent word, a frequent next one, and up to two more; equal ones of a stretch once with their number."""
    for batch in batches:
        for codes in batch.column("codes"):
            whole = codes.values.to_numpy()
            for begin in range(0, len(whole), _STRETCH):
                yield _pointers(whole[begin : begin + _STRETCH + DEPTH - 1], _STRETCH)


def _pointers(codes: np.ndarray, most: int) -> pa.RecordBatch:
    """Pointers that begin at one of the first ``most`` places."""
    s = np.concatenate([codes, np.zeros(DEPTH, np.int64)])
    at = np.flatnonzero((s[:-1] > 0) & (s[1:] > 0))
    at = at[: np.searchsorted(at, most)]
    path = [s[at], s[at + 1]]
    while len(path) < DEPTH:
        path.append(np.where(path[-1] > 0, s[at + len(path)], 0))
    order = np.lexsort(path[::-1])
    path = [x[order] for x in path]
    starts = np.flatnonzero(_changes(path))
    n = np.diff(np.concatenate([starts, [len(at)]]))
    return pa.RecordBatch.from_pydict({c: x[starts] for c, x in zip(_PATH, path, strict=True)} | {"n": n.astype(np.int64)})


def _changes(path: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(path[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in path])
    return new


def _grow(least: int):
    """Frequent phrases of sorted pointers, and parts of prefixes that other tasks hold too."""

    def nodes(path: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        # Low bit of a code: the word occurs more often than a task's share.
        shared = (path & 1).all(axis=1) & (path.shape[1] < DEPTH)
        keep = (path[:, -1] > 0) & (shared | (n >= least))
        return pa.RecordBatch.from_pydict({"path": pa.array(list(path[keep]), pa.list_(pa.int64())), "n": n[keep]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_nodes: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            path = np.column_stack([batch.column(c).to_numpy() for c in _PATH])
            n = batch.column("n").to_numpy()
            for depth in range(DEPTH, 1, -1):  # deeper nodes close first
                here = path[:, :depth]
                starts = np.flatnonzero(_changes(list(here.T)))
                sums, heads = np.add.reduceat(n, starts), here[starts]
                if depth in open_nodes:
                    head, so_far = open_nodes[depth]
                    if (head == heads[0]).all():
                        sums[0] += so_far
                    else:
                        yield nodes(head[None, :], np.array([so_far]))
                open_nodes[depth] = heads[-1].copy(), int(sums[-1])
                yield nodes(heads[:-1], sums[:-1])
        for head, n_open in open_nodes.values():
            yield nodes(head[None, :], np.array([n_open]))

    return run


def _dealt_by() -> list[Column]:
    """A prefix of two words, or of more where all words before occur too often for one task."""
    out, heavy = [F.col("w1"), F.col("w2")], (F.col("w1") % 2 == 1) & (F.col("w2") % 2 == 1)
    for c in _PATH[2:]:
        out.append(F.when(heavy, F.col(c)))
        heavy = heavy & (F.col(c) % 2 == 1)
    return out


def frequent_phrases(docs: DataFrame, least: int = 30, chunk_bytes: int = 4 << 20, task_rows: int = 4 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words and phrases of up to four words that occur at least so often in a language.

    Returns the words (lang, word, code), the phrases (path: codes of their words, f;
    phrases of one word too) and the number of all words (lang, n).
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = materialize(texts.mapInArrow(_to_chunks(chunk_bytes), "chunk long, size long, docs binary").select("chunk", "docs"), "chunks")
    counted = held.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    frequent = materialize(counted.filter((F.col("n") >= least) | F.col("word").isNull()).select(F.monotonically_increasing_id().alias("at"), "*"), "frequent")
    found = frequent.agg(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.max("at")).first()
    tasks = max(partitions(spark), -(-(found[0] or 0) // task_rows))
    share = max(1, (found[0] or 0) // (8 * tasks))
    # Numbers without the gaps between partitions: small ones take little room.
    parts = ((found[1] or 0) >> 33) + 1
    number = (F.col("at") % (1 << 33)) * parts + F.shiftright("at", 33) + 1
    words = frequent.filter("word IS NOT NULL").select("lang", "word", "n", (number * 2 + F.when(F.col("n") > share, 1).otherwise(0)).alias("code"))
    keyed = words.mapInArrow(_keyed, "lang string, word string, n long, code long, key long").select("key", "code")
    answers = held.mapInArrow(_ask, "chunk long, k int, key long").join(keyed, "key").select("chunk", "k", "code")
    encoded = materialize(held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_encode, "codes array<long>"), "codes")
    discard(held)
    pointers = encoded.mapInArrow(_project, ", ".join(f"{c} long" for c in _PATH) + ", n long")
    grown = pointers.repartition(tasks, *_dealt_by()).sortWithinPartitions(*_PATH).mapInArrow(_grow(least), "path array<long>, n long")
    phrases = grown.groupBy("path").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    singles = words.select(F.array("code").alias("path"), F.col("n").alias("f"))
    return words, materialize(phrases.unionByName(singles), "phrases"), frequent.filter("word IS NULL").select("lang", "n")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, **sizes: int) -> DataFrame:
    """The best phrases of two to four words of each language.

    ``docs`` has ``lang`` and ``text``.  A-Z are lower-cased, texts are split at
    ``. , ; : ! ?`` and line ends into pieces, pieces at blanks and tabs into words; f
    counts contiguous occurrences inside pieces.  Candidates have f >= ``least``.  Of
    the cuts of a phrase in two, the lowest floor(2000000 a / (l + r)) is its score
    (ties: the earliest cut).  A candidate inside a longer one goes if 100 f(longer) >=
    80 a.  Returns each language's first ``top`` by score and a descending, then
    phrase: lang, rank, phrase, a, l, r, n, score.

    Nulls: a null text is empty, a null language is ``und``.  Empty texts have no words;
    a very long text is a chunk of its own and taken whole.  Ties and repeats: every row
    counts; equal scores and counts are ordered by the phrase's bytes.  An empty table
    gives no rows.  Other columns, whatever their names, are not read.
    """
    words, phrases, totals = frequent_phrases(docs, least, **sizes)
    longer = phrases.filter(F.size("path") > 1)
    cut = longer.select(F.col("path"), F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.slice("path", F.lit(1), F.col("k")), "tail": F.slice("path", F.col("k") + 1, F.size("path") - F.col("k"))})
    head, tail = (phrases.select(F.col("path").alias(side), F.col("f").alias(c)) for side, c in (("head", "l"), ("tail", "r")))
    score = (_exact("a") * F.lit(2_000_000).cast("decimal(7,0)")).cast("decimal(30,0)")
    scored = cut.join(head, "head").join(tail, "tail").withColumns({"twice": score, "parts": _exact("l") + _exact("r")}).withColumn("score", F.expr("twice div parts"))
    lowest = scored.groupBy("path", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    inside = longer.filter(F.size("path") > 2).select(F.col("f"), F.explode(F.array_distinct(F.expr(
        "flatten(transform(sequence(2, size(path) - 1), m -> transform(sequence(1, size(path) - m + 1), i -> slice(path, i, m))))"
    ))).alias("path")).groupBy("path").agg(F.max("f").alias("held"))
    alone = lowest.join(inside, "path", "left").filter(F.col("held").isNull() | (_exact("held") * 100 < _exact("a") * 80))
    first = words.select(F.col("code").alias("first"), "lang")
    placed = alone.select("path", "a", "s.*", F.col("path")[0].alias("first")).join(first, "first")
    # The texts of those alone that can be among the first, ties included.
    order = [F.col("score").desc(), F.col("a").desc()]
    near_top = placed.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    spelled = near_top.select("path", "lang", "a", "l", "r", "score", F.posexplode("path").alias("i", "code")).join(words.select("code", "word"), "code")
    named = spelled.groupBy("path", "lang", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w")).withColumn("phrase", F.concat_ws(" ", F.col("w.word")))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
