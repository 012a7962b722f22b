"""Near-duplicate embeddings by NN-descent.

Method (Dong et al., "Efficient k-nearest neighbor graph construction for generic
similarity measures", 2011).  A neighbour graph starts from the leaves of a few
random-projection trees and is refined by local joins: the neighbours of a node,
forward and reverse, meet each other.  Only edges close enough to lead to a link
take part.  Lists are cut to the best k, links are not: all links of a leaf or join
go on to the components, as connections of its linked pieces.  A node whose list is
full of links is saturated; saturated nodes are searched again, with lists of nodes
outside their own components, until no components merge.  Components are compared
in blocks.  Recall is audited against brute force on a bounded sample, and more
trees are grown until it is high enough; where they do not suffice, the labels that
miss links are compared whole, in blocks.

Scale.  Vectors are grouped by label and dimension; equal vectors are one class.
Leaves and local joins are groups of bounded size: a crowded leaf is split by
projections from its own mean, then by a salt, and a hub's reverse neighbours come in chunks, all of them.
Links inside a component are counted in its tasks, not sent as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import discard, materialize
from .components import components

BITS = 24
SPREAD = 12
_AUDIT_COLUMNS = "a long, node long"
_EDGES = "u long, v long, sim double, link boolean"


_PREPARED = "vec_id long, label long, dim int, raw binary, codes array<long>"


def _prepare(trees: int, seed: int, kind: str):
    """Vectors as bytes, with a code of BITS projection signs for each tree; null for one that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        places = 1 << np.arange(BITS - 1, -1, -1)
        for batch in batches:
            column = batch.column("embedding")
            begin = column.offsets.to_numpy()
            dims, begin = np.diff(begin), begin[:-1]
            every = column.values.to_numpy(zero_copy_only=False)  # a null component is not a number here
            raws, codes = np.full(len(batch), None, object), np.full(len(batch), None, object)
            for dim in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero(dims == dim)
                x = every[begin[at][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[good], x[good]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(trees * BITS, dim)).T
                signs = (_scaled(x.astype(np.float64)) @ planes[dim] > 0).reshape(len(at), trees, BITS)
                for i, raw, code in zip(at.tolist(), x.astype(kind), (signs @ places).tolist(), strict=True):
                    raws[i], codes[i] = raw.tobytes(), code
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], ["vec_id", "label", "dim", "raw", "codes"])

    return run


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; by their largest component first, so that no square is lost or too large."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(np.float64).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(raws: pa.ChunkedArray, kind: str) -> np.ndarray:
    return _scaled(np.stack([np.frombuffer(r.as_buffer(), kind) for r in raws]).astype(np.float64))


def _leaf(k: int, floor: float, threshold: float, kind: str):
    """The best neighbours of each node among those of one leaf, and the leaf's links."""

    def run(table: pa.Table) -> pa.Table:
        node = np.asarray(table.column("node"))
        return _best(node, _apart(table, kind), k, np.full(len(node), floor), threshold)

    return run


def _apart(table: pa.Table, kind: str) -> np.ndarray:
    """Cosines of nodes of different components; -2 within one."""
    s = _unit(table.column("raw"), kind)
    s = s @ s.T
    component = np.asarray(table.column("component"))
    s[component[:, None] == component] = -2
    return s


def _best(node: np.ndarray, s: np.ndarray, k: int, above: np.ndarray, threshold: float) -> pa.Table:
    top = min(k, len(node) - 1)
    if top < 1:
        u = v = sim = a = b = np.zeros(0)
    else:
        at = np.argpartition(-s, top - 1, axis=1)[:, :top]
        sim = np.take_along_axis(s, at, axis=1)
        ok = sim >= above[:, None]
        u, v, sim = np.repeat(node, top).reshape(-1, top)[ok], node[at][ok], sim[ok]
        a, b = _pieces(node, s >= threshold)
    u, v, sim = np.concatenate([u, a]), np.concatenate([v, b]), np.concatenate([sim, np.ones(len(a))])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(sim, pa.float64()), "link": pa.array(np.arange(len(u)) >= len(u) - len(a))})


def _pieces(node: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's connection to the least one that links of the group lead to."""
    some = np.flatnonzero(linked.any(axis=1))
    node, linked = node[some], linked[np.ix_(some, some)]
    least = node
    while len(node):
        nearer = np.minimum(least, np.where(linked, least, np.iinfo(np.int64).max).min(axis=1))
        if (nearer == least).all():
            break
        least = nearer
    return least[least != node], node[least != node]


def _local_join(k: int, threshold: float, kind: str):
    """Better neighbours among the members of one neighbourhood, and their links."""

    def run(table: pa.Table) -> pa.Table:
        node, first = np.unique(np.asarray(table.column("node")), return_index=True)
        table = table.take(pa.array(first))
        return _best(node, _apart(table, kind), k, np.asarray(table.column("worst")), threshold)

    return run


def _spread(seed: int, kind: str):
    """Projections on SPREAD directions of the row's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, SPREAD))
            dims, trees = (np.asarray(batch.column(c)) for c in ("dim", "tree"))
            for dim, tree in {*zip(dims.tolist(), trees.tolist(), strict=True)}:
                at = np.flatnonzero((dims == dim) & (trees == tree))
                p[at] = _unit(batch.column("raw").take(pa.array(at)), kind) @ np.random.default_rng([seed, dim, tree]).normal(size=(dim, SPREAD))
            yield batch.append_column("p", pa.array(p.tolist(), pa.list_(pa.float64())))

    return run


def _between(threshold: float, kind: str):
    """Connections by links between two blocks, of nodes that are not in one component."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, node, component = (np.asarray(table.column(c)) for c in ("mine", "node", "component"))
        x = _unit(table.column("raw"), kind)
        p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = (x[p] @ x[q].T >= threshold) & (component[p][:, None] != component[q])
        p, q = p[linked.any(axis=1)], q[linked.any(axis=0)]
        both = np.union1d(p, q)
        square = np.zeros((len(both), len(both)), bool)
        square[np.ix_(np.searchsorted(both, p), np.searchsorted(both, q))] = linked[np.ix_(linked.any(axis=1), linked.any(axis=0))]
        a, b = _pieces(node[both], square | square.T)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _count(threshold: float, kind: str):
    """Links of each node to the other block of a pair, each copy of a vector counted."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, node, copies = (np.asarray(table.column(c)) for c in ("mine", "node", "copies"))
        x = _unit(table.column("raw"), kind)
        out = []
        p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = x[p] @ x[q].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        out.append((node[p], linked @ copies[q]))
        if i != j:
            out.append((node[q], linked.T @ copies[p]))
        return pa.table({"node": pa.array(np.concatenate([a for a, _ in out]), pa.int64()), "n": pa.array(np.concatenate([b for _, b in out]), pa.int64())})

    return run


def _brute(sample, threshold: float, kind: str):
    """True links of the sample's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sample.value
        for batch in batches:
            a, b = [], []
            labels, dims, node = (np.asarray(batch.column(c)) for c in ("label", "dim", "node"))
            for (label, dim), (ids, vectors) in groups.items():
                here = np.flatnonzero((labels == label) & (dims == dim))
                if len(here):
                    s = vectors @ _unit(batch.column("raw").take(pa.array(here)), kind).T >= threshold
                    x, y = np.nonzero(s)
                    a.append(ids[x])
                    b.append(node[here[y]])
            a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (a, b))
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "node"])

    return run


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node, and all links; at most k rows a task and node come together."""
    once = edges.groupBy("u", "v", "link").agg(F.max("sim").alias("sim"))
    of = Window.partitionBy("u", F.when(F.col("link"), F.col("v"))).orderBy(F.desc("sim"), "v")
    return once.withColumn("r", F.row_number().over(of)).filter(F.col("r") <= k)


def _leaves(nodes: DataFrame, first: int, trees: int, leaf: int, kind: str) -> GroupedData:
    """The leaves of some trees, about ``leaf`` nodes each.

    A crowded one is split by the sides on which its nodes lie of its mean, so that
    near nodes stay together; what is still crowded then is dealt by a salt.
    """
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    depth = F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.col("n") / leaf)).cast("int")))
    grown = nodes.join(sizes, ["label", "dim"]).select("node", "raw", "component", "label", "dim", depth.alias("depth"), F.posexplode(F.slice("codes", 1 + first, trees)).alias("tree", "code"))
    cell = ["label", "dim", "tree", "cell"]
    grown = grown.withColumn("cell", F.expr(f"shiftright(code, {BITS} - depth)")).select("node", "raw", "component", *cell)
    parts = F.ceil(F.count("*") / (4 * leaf)).alias("parts")
    dealt = grown.join(grown.groupBy(*cell).agg(parts), cell)
    crowded = dealt.filter("parts > 1")
    crowded = crowded.mapInArrow(_spread(first + 1, kind), T.StructType([*crowded.schema, T.StructField("p", T.ArrayType(T.DoubleType()))]))
    means = crowded.groupBy(*cell).agg(F.array(*(F.avg(F.col("p")[i]) for i in range(SPREAD))).alias("mean"))
    side = F.expr("aggregate(sequence(0, least(size(p), cast(ceil(log2(parts)) as int) + 1) - 1), 0, (c, i) -> 2 * c + if(p[i] > mean[i], 1, 0))")
    crowded = crowded.join(means, cell).select("node", "raw", "component", *cell, side.alias("side"))
    crowded = crowded.join(crowded.groupBy(*cell, "side").agg(parts), [*cell, "side"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    calm = dealt.filter("parts = 1").withColumn("side", F.lit(0)).withColumn("part", F.lit(0).cast("long"))
    both = ["node", "raw", "component", *cell, "side", "part"]
    return calm.select(*both).unionByName(crowded.select(*both)).groupBy(*cell, "side", "part")


def linked_components(vectors: DataFrame, threshold: float = 0.93, k: int = 10, trees: int = 10, leaf: int = 64, rounds: int = 6, recall: float = 0.99, audit: int = 512, retries: int = 2, report: dict | None = None) -> DataFrame:
    """Links and components of vectors with equal labels.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``.  Two vectors link if
    their labels (and dimensions) are equal, no label is null and their cosine in
    double precision is at least ``threshold``.  Returns per row vec_id, n_links
    (other rows linked directly), component_id (least vec_id reachable, itself
    included) and kept (vec_id = component_id).

    Nulls and empties: vectors that are null, empty, zero or hold a null or non-finite
    component, and rows with a null label or id, link with nothing; a null id has no
    component_id and is kept.  Components of any finite size count, since vectors are
    scaled before they are squared.  Very long vectors are compared whole.  Ties and
    repeats: a cosine of the threshold itself links; equal vectors link with each
    other; rows that repeat an id are one node for components.  An empty table gives
    no rows.  Other columns, whatever their names, are not read.  ``report`` receives
    the audited recall of each attempt, and of each comparison of whole labels after
    them.
    """
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType
    kind = "<f4" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "<f8"
    if kind == "<f8":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    valid = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    read = materialize(valid.mapInArrow(_prepare(trees * (retries + 1), 17, kind), _PREPARED), "vectors")
    prepared = read.filter("raw IS NOT NULL")
    classes = prepared.groupBy("label", "dim", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("codes").alias("codes"))
    # A node is a class; its number is unlike other nodes' even where ids repeat.
    nodes = materialize(classes.withColumn("node", F.xxhash64("rep", "label", "dim", "raw")), "nodes")
    alone = nodes.withColumn("component", F.col("node"))
    floor = max(-1.0, 2 * threshold**2 - 1)  # an edge on a path of two to a link is no wider than twice its angle
    edges, missed = None, None
    for attempt in range(retries + 1):
        found = _leaves(alone, attempt * trees, trees, leaf, kind).applyInArrow(_leaf(k, floor, threshold, kind), _EDGES)
        graph = materialize(_top(found if edges is None else found.unionByName(edges.drop("r")), k), "graph")
        before = -1
        for _ in range(rounds):
            # Links of nodes that are not saturated: what another round can still add to.
            open_ = graph.filter("NOT link").groupBy("u").agg(F.sum((F.col("sim") >= threshold).cast("int")).alias("links")).filter(F.col("links") < k).agg(F.sum("links")).first()[0] or 0
            if open_ == before:
                break
            before = open_
            finer = materialize(_refined(graph, alone, k, threshold, kind), "graph")
            discard(graph)
            graph = finer
        edges = graph
        links = edges.filter(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        joined = materialize(components(links if missed is None else links.unionByName(missed)), "components")
        joined = _bridged(edges, nodes, joined, k, floor, threshold, kind, trees * (retries + 1), leaf, rounds)
        missed_now, score = _audited(nodes, joined, threshold, kind, audit, attempt)
        if report is not None:
            report.setdefault("recall", []).append(score)
        if missed_now is not None:
            missed = missed_now if missed is None else missed.unionByName(missed_now)
            joined = _merged(joined, missed_now)
        if score >= recall:
            break
    while score < recall:
        # More trees do not suffice: labels that miss links are compared whole, which leaves none to miss there.
        joined = _compared(nodes, joined, missed_now, threshold, kind)
        attempt += 1
        missed_now, score = _audited(nodes, joined, threshold, kind, audit, attempt)
        if report is not None:
            report["recall"].append(score)
        if missed_now is not None:
            joined = _merged(joined, missed_now)
    counts = _links(nodes, joined, threshold, kind)
    per_node = nodes.join(counts, "node", "left").join(joined, "node", "left")
    per_node = materialize(per_node.select("label", "dim", "raw", "node", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "counted")
    # Components of nodes as components of ids: ids that repeat join their nodes.
    member = prepared.join(per_node.select("label", "dim", "raw", "n_links", "component"), ["label", "dim", "raw"]).select("vec_id", "n_links", "component")
    member = materialize(member, "members")
    least = member.groupBy("component").agg(F.min("vec_id").alias("least"))
    star = member.join(least, "component").select(F.col("least").alias("a"), F.col("vec_id").alias("b"))
    ids = materialize(components(star), "ids")
    good = member.select("vec_id", "n_links")
    odd = rows.filter("vec_id IS NULL OR label IS NULL OR embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    flawed = read.filter("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = good.unionByName(odd).unionByName(flawed).join(ids.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    return out.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("vec_id")), F.lit(True)).alias("kept"))


def _refined(graph: DataFrame, nodes: DataFrame, k: int, threshold: float, kind: str, floor: float = -1.0, beside: DataFrame | None = None) -> DataFrame:
    """One round of neighbours-of-neighbours: forward and reverse lists of a node meet.

    Neighbours ``beside`` the lists take part too.
    """
    lists = graph.filter("NOT link")
    worst = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("low")).select(F.col("u").alias("node"), F.when(F.col("n") >= k, F.col("low")).otherwise(floor).alias("worst"))
    around = lists.select("u", "v") if beside is None else lists.select("u", "v").unionByName(beside)
    forward = around.select(F.col("u").alias("middle"), F.col("v").alias("node"))
    reverse = around.select(F.col("v").alias("middle"), F.col("u").alias("node"))
    # All reverse neighbours take part, in chunks of about 2k, each with the forward list.
    chunks = reverse.groupBy("middle").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (2 * k))).cast("int").alias("chunks"))
    back = reverse.join(chunks, "middle").select("middle", "node", F.pmod(F.xxhash64("node", "middle"), F.col("chunks")).cast("int").alias("chunk"))
    ahead = forward.join(chunks, "middle", "left").select("middle", "node", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    members = back.unionByName(ahead).distinct().join(nodes.select("node", "raw", "component"), "node").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(floor)))
    found = members.groupBy("middle", "chunk").applyInArrow(_local_join(k, threshold, kind), _EDGES)
    return _top(found.unionByName(graph.drop("r")), k)


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links (a, b)."""
    stars = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialize(components(stars.unionByName(links)), "components")


def _bridged(edges: DataFrame, nodes: DataFrame, joined: DataFrame, k: int, floor: float, threshold: float, kind: str, trees: int, leaf: int, rounds: int) -> DataFrame:
    """Components after a search for links between saturated nodes of different ones.

    Only a pair whose ends are both saturated can have been cut from both lists.
    Each pass fills the lists from outside a node's component, so none is full of
    links it has; passes go on until one finds no link.
    """
    lists = edges.filter("NOT link")
    full = lists.filter(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("u")
    saturated = materialize(nodes.join(full.withColumnRenamed("u", "node"), "node"), "saturated")
    beside = lists.join(full, "u", "left_semi").select("u", "v")
    while not saturated.isEmpty():
        placed = saturated.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        outside = materialize(_top(_leaves(placed, 0, trees, leaf, kind).applyInArrow(_leaf(k, floor, threshold, kind), _EDGES), k), "outside")
        for _ in range(rounds):
            if outside.isEmpty() or not outside.filter("link").isEmpty():
                break
            finer = materialize(_refined(outside, placed, k, threshold, kind, floor, beside), "outside")
            discard(outside)
            outside = finer
        across = outside.filter("link").select(F.col("u").alias("a"), F.col("v").alias("b"))
        merges = not across.isEmpty()
        if merges:
            joined = _merged(joined, across)
        discard(outside)
        if not merges:
            break
    discard(saturated)
    return joined


def _audited(nodes: DataFrame, joined: DataFrame, threshold: float, kind: str, audit: int, seed: int) -> tuple[DataFrame | None, float]:
    """Links of a bounded sample that brute force finds and the graph's components miss; recall.

    Recall is a mean over sampled vectors that have links, or over their components
    if that is less: neither many links nor many vectors of one group hide the others'.
    """
    spark = nodes.sparkSession
    rows = nodes.select("node", "label", "dim", "raw").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(audit).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.label, r.dim), []).append(r)
    sample = {g: (np.array([r.node for r in rs]), _unit(pa.chunked_array([pa.array([bytes(r.raw) for r in rs], pa.binary())]), kind)) for g, rs in groups.items()}
    true = nodes.select("node", "label", "dim", "raw").mapInArrow(_brute(spark.sparkContext.broadcast(sample), threshold, kind), _AUDIT_COLUMNS)
    c = joined.withColumnRenamed("node", "x")
    placed = true.join(c.select(F.col("x").alias("a"), F.col("component").alias("ca")), "a", "left").join(c.select(F.col("x").alias("node"), F.col("component").alias("cb")), "node", "left")
    placed = materialize(placed.select("a", F.col("node").alias("b"), "ca", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("same")), "audit")
    each = placed.groupBy("a").agg(F.avg(F.col("same").cast("int")).alias("found"), F.first("ca").alias("ca"))
    groups = each.groupBy(F.coalesce("ca", "a")).agg(F.sum("found").alias("found"), F.count("*").alias("n"))
    by_vector, by_group = groups.agg(F.sum("found") / F.sum("n"), F.avg(F.col("found") / F.col("n"))).first()
    score = 1.0 if by_vector is None else min(by_vector, by_group)
    return (placed.filter("NOT same").select("a", "b") if score < 1 else None), score


def _blocks(rows: DataFrame, by: list[str], block: int) -> GroupedData:
    """Each pair (i, j) of blocks of each group's nodes; ``mine`` is a node's block."""
    size = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(size, by).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("mine"), j).alias("i"), F.greatest(F.col("mine"), j).alias("j")))
    tasks = dealt.withColumn("t", F.explode(pair)).drop("blocks")
    return tasks.withColumns({"i": F.col("t.i"), "j": F.col("t.j")}).drop("t").groupBy(*by, "i", "j")


def _compared(nodes: DataFrame, joined: DataFrame, missed: DataFrame, threshold: float, kind: str, block: int = 1024) -> DataFrame:
    """Components after all nodes of the missed links' labels have met."""
    labels = missed.select(F.col("a").alias("node")).join(nodes, "node").select("label", "dim").distinct()
    rows = nodes.select("node", "label", "dim", "raw").join(labels, ["label", "dim"]).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return _merged(joined, _blocks(rows, ["label", "dim"], block).applyInArrow(_between(threshold, kind), "a long, b long"))


def _links(nodes: DataFrame, joined: DataFrame, threshold: float, kind: str, block: int = 2048) -> DataFrame:
    """Links of each node to other nodes, counted inside components, block by block."""
    rows = joined.join(nodes.select("node", "raw", "copies"), "node")
    return _blocks(rows, ["component"], block).applyInArrow(_count(threshold, kind), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
