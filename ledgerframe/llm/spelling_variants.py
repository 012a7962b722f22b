"""Groups of words that are spelling variants of a more frequent one.

Method: a symmetric-delete join.  Every word emits itself and its distinct single
deletions; words that share a key are joined, pairs at a distance of exactly one are
kept, the most frequent near word of each word becomes its form, and forms are joined
to themselves until every word has its root.

Scale.  Words are counted in tasks before they are shuffled, so a word that makes up
a third of the corpus is one row per task.  A key is a 64-bit hash, computed from
prefix sums: a word of a million letters emits a million short rows, not a million
words.  A key takes along the run of positions at which the deletion can stand; two
words of one key are near exactly if these runs meet, so the join passes on no pair
that is not near but for collisions of hashes; the texts without that position, equal
to the letter, confirm each.  Words that
share a key differ from it by one letter of a known alphabet, which bounds a key's
group by 90 times its length: no key is hot.  Chains of forms at least double in
count, so roots are found in a few doubling joins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import discard, materialize
from ._words import LOWER, U, mix, multipliers

_LOW = {c: int(LOWER[c]) for c in range(0x41, 0x5B)}
_BASE = int(multipliers(1, seed=11)[0])
_UNBASE = pow(_BASE, -1, 1 << 64)
_WHOLE = np.iinfo(np.int32).max


def _count_words(shortest: int, every: int, held: int = 1 << 19):
    """Counts of words in a task, given out whenever so many distinct ones are held."""
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % shortest)

    def words_of(doc_id: int | None, text: str) -> Counter:
        lowered: Counter = Counter()
        for run, n in Counter(m.group() for m in runs.finditer(text)).items():
            lowered[run.lower() if run.isascii() else run.translate(_LOW)] += n
        out: Counter = Counter()
        head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, n in lowered.items():
            h = zlib.crc32(run.encode(), head)
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
                if len(run) < shortest:
                    continue
            out[run] += n
        return out

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid:
                    counts.update(words_of(doc_id, text.as_py()))
                if len(counts) >= held:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return run


def _deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, first and last position of every distinct single deletion, and of each word itself at any position.

    Deleting any letter of a run of equal letters gives the same string, so distinct
    deletions are the runs.
    """
    n = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U)
    starts = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(points)) - starts[row]
    most = int(n.max(initial=0)) + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[U(1)], np.full(most, U(_BASE))]), dtype=U)
        value = mix(points + U(1)) * up[at]
        sums = np.concatenate([[U(0)], np.cumsum(value, dtype=U)])
        before = sums[:-1] - sums[starts[row]]
        after = sums[starts[row + 1]] - sums[1:]
        key = mix(before + after * U(_UNBASE) + (n[row] - 1).astype(U))
        whole = mix(sums[starts[1:]] - sums[starts[:-1]] + n.astype(U))
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(points)]])[: len(first)] - 1
    return (
        np.concatenate([row[first], np.arange(len(words))]), np.concatenate([key[first], whole]),
        np.concatenate([at[first], np.zeros(len(words), np.int64)]), np.concatenate([at[last], np.full(len(words), _WHOLE)]),
    )


def _to_keys(letters: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
            sizes = np.cumsum([len(w) for w in words])
            at = 0
            while at < len(words):  # as many words as have so many letters together, or one
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + letters, "right")))
                row, key, low, high = _deletions(words[at:to])
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "id": ids[at:to][row], "low": low.astype(np.int32), "high": high.astype(np.int32)})
                at = to

    return run


def _without(word: str, whole: str) -> Column:
    """A word without its code point ``at`` (from 0), or the whole word."""
    return F.when(F.col(whole), F.col(word)).otherwise(F.concat(F.substring(word, F.lit(1), F.col("at")), F.substring(word, F.col("at") + 2, F.length(word))))


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs of words at a distance of exactly one inserted, deleted or replaced code point.

    ``words`` has a unique ``id`` and ``word`` and ``n``; returns id, n, near_id,
    near_word, near_n, each pair both ways.
    """
    keys = materialize(words.select("id", "word").mapInArrow(_to_keys(), "key long, id long, low int, high int"), "deletions")
    a, b = keys.alias("a"), keys.alias("b")
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high"))
    whole = [(F.col(f"{side}.high") == _WHOLE).alias(f"{side}_whole") for side in "ab"]
    pairs = a.join(b, meets).select(F.col("a.id").alias("id"), F.col("b.id").alias("near_id"), F.greatest("a.low", "b.low").alias("at"), *whole)
    near = words.select(F.col("id").alias("near_id"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    found = pairs.join(words.select("id", "word", "n"), "id").join(near, "near_id").filter(_without("word", "a_whole") == _without("near_word", "b_whole"))
    return found.select(F.explode(F.array(
        F.struct("id", "n", "near_id", "near_word", "near_n"),
        F.struct(F.col("near_id").alias("id"), F.col("near_n").alias("n"), F.col("id").alias("near_id"), F.col("word").alias("near_word"), F.col("n").alias("near_n")),
    )).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """The last form of every ``id`` along its chain of ``form_id``; chains must not be cycles."""
    found = materialize(forms.select("id", F.col("form_id").alias("root_id")), "roots")
    while True:
        on = found.select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"))
        further = materialize(found.join(on, "root_id", "left").select("id", F.coalesce("next_id", "root_id").alias("root_id"), F.col("next_id").isNotNull().alias("moved")), "roots")
        discard(found)
        found = further
        if not found.filter("moved").limit(1).count():
            return found.drop("moved")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """The words of a corpus, each with the more frequent word it is probably a variant of.

    ``docs`` has ``doc_id`` and ``text``.  Words are the maximal runs of A-Z, a-z and
    U+00C0 to U+00FF, A-Z lower-cased; a run whose crc32 of ``<doc_id>:<run>`` is
    divisible by ``every`` loses one code point.  Words of at least ``shortest`` code
    points and ``least`` occurrences count.  A word's form is its near word (distance
    one) of largest n, ties to the smallest word, if that n is at least ``ratio``
    times the word's; ``ratio`` must be 2 or more.  Returns word, form, root, n,
    n_near, form_n.

    Nulls: a null text has no words; a null id is empty in ``<doc_id>:<run>``.  Empty
    texts have no words; a very long text or word is taken whole.  Ties and repeats:
    every row counts, rows with equal ids and texts too.  An empty table gives no
    rows.  Other columns, whatever their names, are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms may be cycles")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_count_words(shortest, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    words = materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near_word", "near_id")).alias("best")
    nearest = near_words(words).groupBy("id", "n").agg(F.count("*").alias("n_near"), best)
    is_form = F.col("n") * ratio <= -F.col("best.minus")
    linked = materialize(nearest.select(
        "id", "n_near", F.when(is_form, F.col("best.near_id")).alias("form_id"), F.when(is_form, F.col("best.near_word")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")
    ), "nearest")
    last = roots(linked.filter("form_id IS NOT NULL"))
    named = last.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    out = words.join(linked, "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
