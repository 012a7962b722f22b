"""Near-duplicate documents by MinHash signatures and an inverted coordinate join.

Method.  Every document's set of word shingles gets a signature of
``coordinates`` minima.  A document is posted under each (coordinate, value)
pair.  Two sets of similarity ``J`` agree on about ``coordinates * J`` pairs;
those that agree on at least ``match`` are candidates, where ``match`` lies five
standard deviations below that mean (by the binomial tail at 64 coordinates a pair
just at the limit is missed with a probability of 2.4e-6 at 0.85, 1.2e-6 at 0.8).
Collisions are counted with prefix and skip merging:
two documents with ``match`` common postings share one among the
``coordinates - match + 1`` rarest postings of each, so only these prefixes are
merged, and the rest of the count skips to the signatures.  Candidates are
confirmed on full shingle sets.

Scale.  Documents with equal sets are one class from the start.  Postings are
also split by set size, since similar sets have similar sizes.  Two members of a
small posting meet as a pair, and pairs that collide on fewer than ``meet``
prefix postings go before anything is attached to them.  A large posting makes no
pairs: its members first meet one central hub, confirmed links are contracted to
components, and members outside the main component are compared in blocks of
bounded bytes, on full sets, against all members; a block gives back a spanning
forest of its links.  So a group of thousands of near copies makes a few rows a
member, in many tasks, and loses no link that could change a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import discard, materialize
from ._words import SPACED, U, Words, buffers, mix, multipliers, pieces
from .components import components

_PIECE = 2 << 20


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and bounds by text.

    A text of fewer words, but some, has its whole sequence as its only shingle.
    """
    h = words.hashes()
    at, value = words.windows(h, n, seed=3)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    rows = row[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    with np.errstate(over="ignore"):
        few = np.array([mix(np.sum(h[words.bounds[i] : words.bounds[i + 1]] * multipliers(int(words.counts[i]), 10 + int(words.counts[i])), dtype=U, keepdims=True))[0] for i in short], U)
    counts = np.bincount(rows, minlength=len(words.counts))
    if len(short):
        rows, value = np.concatenate([rows, short]), np.concatenate([value, few])
        order = np.argsort(rows, kind="stable")
        rows, value = rows[order], value[order]
        counts = np.bincount(rows, minlength=len(words.counts))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for i in range(len(counts)):
        value[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=len(words.counts)))])


def signatures(value: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """The least high half of each hash, by text with shingles and coordinate."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), coordinates), np.uint32)
    a, b = multipliers(coordinates, 7), multipliers(coordinates, 8)
    step = 1 << 15
    with np.errstate(over="ignore"):
        low = np.searchsorted(starts, np.arange(0, len(value), step))
        cuts = np.unique(np.concatenate([low, [len(starts)]]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            first, last = starts[lo], starts[hi] if hi < len(starts) else len(value)
            part, at = value[first:last], starts[lo:hi] - first
            for j in range(coordinates):
                out[lo:hi, j] = np.minimum.reduceat((part * a[j] + b[j]) >> U(32), at)
    return out


def _signed(n: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                value, bounds = shingles(Words(*buffers(piece.column("text")), SPACED, True), n)
                size = np.diff(bounds)
                sums = [np.add.reduceat(np.append(mix(value ^ U(s)), U(0)), bounds[:-1]) for s in (11, 13)] if len(value) else [np.zeros(len(size), U)] * 2
                full = np.flatnonzero(size)
                sig: list = [None] * len(size)
                for i, s in zip(full.tolist(), signatures(value, bounds, coordinates), strict=True):
                    sig[i] = s.view(np.int32).tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"),
                    "n_shingles": pa.array(size, pa.int64()),
                    "set_a": pa.array(np.where(size > 0, sums[0], U(0)).view(np.int64), pa.int64()),
                    "set_b": pa.array(np.where(size > 0, sums[1], U(0)).view(np.int64), pa.int64()),
                    "signature": pa.array(sig, pa.binary()),
                })

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                value, bounds = shingles(Words(*buffers(piece.column("text")), SPACED, True), n)
                yield pa.RecordBatch.from_pydict({"rep": piece.column("doc_id"), "shingles": pa.array([value[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([p, q])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _matching(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(len(batch), -1) for c in "xy")
                keep = pa.array((p == q).sum(axis=1) >= least)
                batch = pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
                yield batch

    return run


def _intersections(sets: list[np.ndarray], dense_from: int = 32, columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections: common shingles as matrix products, rarer ones pair by pair."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    run = np.cumsum(new) - 1
    size = np.bincount(run)[run]
    often = size > dense_from
    column = np.unique(run[often], return_inverse=True)[1]
    member = doc[often]
    for at in range(0, int(column.max(initial=-1)) + 1, columns):
        here = (column >= at) & (column < at + columns)
        m = np.zeros((n, columns), np.float32)
        m[member[here], column[here] - at] = 1
        out += m @ m.T
    few = np.flatnonzero(~often)
    for d in range(1, dense_from):
        ok = few[few + d < len(run)]
        ok = ok[run[ok + d] == run[ok]]
        if not len(ok):
            break
        np.add.at(out, (doc[ok], doc[ok + d]), 1)
        np.add.at(out, (doc[ok + d], doc[ok]), 1)
    return out


def _block(table: pa.Table) -> pa.Table:
    """The sets of one block of a posting in one row."""
    sink = pa.BufferOutputStream()
    inner = table.select(["rep", "shingles"])
    with pa.ipc.new_stream(sink, inner.schema) as out:
        out.write_table(inner)
    first = table.slice(0, 1).select(["key", "bucket", "outside", "mine", "outer_blocks", "main_blocks"])
    return first.append_column("block", pa.array([sink.getvalue().to_pybytes()], pa.binary()))


def _forest(percent: int):
    """Links inside two blocks of sets, as edges to the least member of their component there."""

    def run(table: pa.Table) -> pa.Table:
        table = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("block")])
        reps = np.asarray(table.column("rep"))
        reps, first = np.unique(reps, return_index=True)
        blobs = table.column("shingles")
        sets = [np.frombuffer(blobs[int(i)].as_buffer(), U) for i in first]
        size = np.array([len(x) for x in sets])
        common = _intersections(sets)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        label = np.arange(len(reps))
        while True:
            least = np.where(linked, label[None, :], len(reps)).min(axis=1)
            least = np.minimum(label, least)
            if (least == label).all():
                break
            label = least
        moved = np.flatnonzero(label != np.arange(len(reps)))
        return pa.table({"a": pa.array(reps[label[moved]], pa.int64()), "b": pa.array(reps[moved], pa.int64())})

    return run


def match_threshold(coordinates: int, percent: int) -> int:
    j = percent / 100
    return max(1, floor(coordinates * j - 5 * sqrt(coordinates * j * (1 - j))))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 64, meet: int = 3, small: int = 32, block_bytes: int = 8 << 20) -> DataFrame:
    """Components of documents whose shingle sets are similar.

    ``docs`` has ``doc_id`` and ``text``.  A-Z are lower-cased; words are runs of
    characters other than ASCII white space; a document's set holds its distinct
    shingles of ``words`` words (fewer words: the whole sequence).  Two documents
    are linked if ``100 * intersection >= percent * union``.  Returns per row
    doc_id, n_shingles, component_id (least doc_id reachable, itself included)
    and kept (doc_id = component_id).

    Nulls: a null text has an empty set; rows with a null id link with nothing, have no
    component_id, and are kept.  Empty texts have an empty set and link with nothing.
    Very long texts have their whole set, beyond the size of a batch too.  Ties and
    repeats: a similarity of the limit itself links; rows with equal ids are one node.
    An empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    least = match_threshold(coordinates, percent)
    meet = min(meet, least)
    prefix = coordinates - least + meet
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(narrow.mapInArrow(_signed(words, coordinates), "doc_id long, n_shingles long, set_a long, set_b long, signature binary"), "signed")

    # Equal sets are one class, named by its least document.
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    several = classes.filter("last > rep").select("n_shingles", "set_a", "set_b", "rep")
    copies = materialize(full.join(several, ["n_shingles", "set_a", "set_b"]).filter("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "copies")
    key = ["n_shingles", "set_a", "set_b", "doc_id"]
    reps = full.join(classes.withColumnRenamed("rep", "doc_id").drop("last"), key).groupBy(*key).agg(F.first("signature").alias("signature"))
    reps = materialize(reps.select(F.xxhash64("doc_id", "set_a", "set_b").alias("node"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "signature"), "reps")

    # Postings under (coordinate, value); those with one member only count as rarest.
    value = F.conv(F.hex(F.substring("signature", F.col("c") * 4 + 1, F.lit(4))), 16, 10).cast("long")
    posted = reps.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(coordinates - 1)))).select("node", "rep", "n", (F.col("c").cast("long") * F.lit(1 << 32) + value).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    found = posted.join(shared, "key").groupBy("node", "rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("ps"))
    found = found.withColumn("take", F.lit(prefix - coordinates) + F.size("ps")).filter("take > 0")
    # Similar sets differ in size by less than one bucket (wider by a hair, for rounding), so they share one.
    bucket = F.floor(F.log("n") / F.lit(-log(percent / 100) * (1 + 1e-9) if percent < 100 else 1.0)).cast("int")
    posts = found.select("rep", "n", bucket.alias("own"), F.explode(F.slice("ps", F.lit(1), F.col("take"))).alias("p"))
    posts = posts.select("rep", "n", "own", F.col("p.key").alias("key"), F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("bucket"))
    sizes = posts.groupBy("key", "bucket").agg(F.count("*").alias("members")).filter("members > 1")
    posts = materialize(posts.join(sizes, ["key", "bucket"]), "postings")

    # Small postings: pairs with enough collisions.
    few = posts.filter(F.col("members") <= small)
    l, r = few.alias("l"), few.select("key", "bucket", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("own").alias("own2"))
    met = l.join(r, ["key", "bucket"]).filter("rep < rep2 AND bucket = greatest(own, own2)").filter(F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2"))
    pairs = met.groupBy(F.col("rep").alias("a"), F.col("rep2").alias("b")).agg(F.count("*").alias("hits")).filter(F.col("hits") >= meet).select("a", "b")

    # Large postings: every member and the most central one.
    many = posts.filter(F.col("members") > small)
    weight = many.groupBy("rep").agg(F.sum("members").alias("weight"))
    hubs = many.join(weight, "rep").groupBy("key", "bucket").agg(F.max(F.struct("weight", "rep")).alias("hub")).select("key", "bucket", F.col("hub.rep").alias("hub"))
    to_hub = many.join(hubs, ["key", "bucket"]).filter("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    likely = _likely(pairs.unionByName(to_hub).distinct(), reps, least)
    sets = materialize(_needed_sets(likely, many, narrow, words), "sets")
    links = materialize(copies.unionByName(_confirmed(likely, sets, percent)), "links")
    joined = components(links)
    if many.take(1):
        links = materialize(links.unionByName(_within(many, joined, sets, percent, block_bytes)), "links")
        joined = components(links)
    joined = materialize(joined, "components")
    out = signed.select("doc_id", "n_shingles").join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    discard(classes, reps, posts, sets, likely)
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("doc_id")), F.lit(True)).alias("kept"))


def _likely(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs whose whole signatures match on enough coordinates."""
    sig = reps.select("rep", "signature")
    with_sig = pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("x")), "a").join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("y")), "b")
    return materialize(with_sig.select("a", "b", "x", "y").mapInArrow(_matching(least), "a long, b long").distinct(), "likely")


def _needed_sets(likely: DataFrame, many: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    ends = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(many.select("rep")).distinct()
    return docs.join(ends, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(words), "rep long, shingles binary")


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    checked = likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    return checked.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long").distinct()


def _within(many: DataFrame, joined: DataFrame, sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links inside large postings between members that are still apart."""
    group = ["key", "bucket"]
    comp = F.coalesce("component", "rep").alias("comp")
    # Two sets of the lower size meet in their own bucket.
    many = many.join(many.filter("own = bucket").select(*group).distinct(), group, "left_semi")
    now = many.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(*group, "rep", comp)
    by_comp = now.groupBy(*group, "comp").agg(F.count("*").alias("n_comp"))
    main = by_comp.groupBy(*group).agg(F.max(F.struct("n_comp", "comp")).alias("main"), F.sum("n_comp").alias("total"), F.count("*").alias("comps")).filter("comps > 1")
    # Blocks of at most 1024 sets and about half of block_bytes.
    size = F.greatest(F.lit(4), F.least(F.lit(1024), (F.lit(block_bytes // 16) * F.pow(F.lit(percent / 100), F.col("bucket"))).cast("int")))
    main = main.select(*group, F.col("main.comp").alias("main"), F.ceil((F.col("total") - F.col("main.n_comp")) / size).cast("int").alias("outer_blocks"), F.ceil(F.col("main.n_comp") / size).cast("int").alias("main_blocks"))
    now = now.join(main, group)
    outside = F.col("comp") != F.col("main")
    mine = F.pmod(F.xxhash64("rep"), F.when(outside, F.col("outer_blocks")).otherwise(F.col("main_blocks"))).cast("int")
    now = now.withColumns({"mine": mine, "outside": outside})
    packed = now.join(sets, "rep").groupBy(*group, "outside", "mine", "outer_blocks", "main_blocks").applyInArrow(_block, "key long, bucket int, outside boolean, mine int, outer_blocks int, main_blocks int, block binary")
    outer = F.sequence(F.lit(0), F.col("outer_blocks") - 1)
    with_outer = F.transform(outer, lambda j: F.struct(F.least(F.col("mine"), j).alias("i"), F.greatest(F.col("mine"), j).alias("j")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: F.struct(F.col("mine").alias("i"), (-1 - j).alias("j")))
    from_main = F.transform(outer, lambda i: F.struct(i.alias("i"), (-1 - F.col("mine")).alias("j")))
    tasks = packed.select(*group, "block", F.explode(F.when(F.col("outside"), F.concat(with_outer, with_main)).otherwise(from_main)).alias("task"))
    return tasks.select(*group, "block", "task.i", "task.j").groupBy(*group, "i", "j").applyInArrow(_forest(percent), "a long, b long").distinct()
