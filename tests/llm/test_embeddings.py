import numpy as np

from ledgerframe.llm.embedding_dedup import linked_components

from .test_dedup import least_reachable

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    def link(p, q):
        if p[2] is None or p[2] != q[2] or p[1] is None or q[1] is None or None in p[1] or None in q[1] or len(p[1]) != len(q[1]) or not p[1]:
            return False
        x, y = np.array(p[1], np.float32).astype(float), np.array(q[1], np.float32).astype(float)
        a, b = np.linalg.norm(x), np.linalg.norm(y)
        return bool(np.isfinite(a) and np.isfinite(b) and a and b and x @ y / (a * b) >= threshold)

    n = [sum(link(p, q) for j, q in enumerate(rows) if j != i) for i, p in enumerate(rows)]
    least = least_reachable({r[0] for r in rows if r[0] is not None}, [(p[0], q[0]) for i, p in enumerate(rows) for q in rows[:i] if p[0] is not None and q[0] is not None and link(p, q)])
    return sorted((-1 if r[0] is None else r[0], k if r[0] is not None else 0, least.get(r[0], -1)) for r, k in zip(rows, n))


def result(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in df.collect())


def vectors(seed=2, n=200, d=12):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=d).astype(np.float32).tolist(), int(r.integers(0, 3))) for i in range(n)]
    for i in range(n, n + 60):
        _, base, label = rows[int(r.integers(0, 8))]
        rows.append((i, (np.array(base) + r.normal(0, 0.05, d)).astype(np.float32).tolist(), label))
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], rows[0][2]), (302, rows[0][1], None), (303, None, 1), (304, [0.0] * d, 1), (305, [None] + [1.0] * (d - 1), 1), (306, [float("nan")] * d, 1), (307, [], 1), (308, [1.0, 2.0], 1), (308, [2.0, 4.0], 1)]
    return rows


def test_links_and_components(spark):
    rows, report = vectors(), {}
    got = linked_components(spark.createDataFrame(rows, SCHEMA).repartition(3), k=6, report=report)
    assert result(got) == brute(rows, 0.93)
    assert report["recall"][-1] >= 0.99


def test_saturated_lists_are_enlarged(spark):
    """A tight group far larger than the lists: every link is counted."""
    r = np.random.default_rng(3)
    base = r.normal(size=16)
    rows = [(i, (base + r.normal(0, 0.02, 16)).astype(np.float32).tolist(), 1) for i in range(150)]
    got = linked_components(spark.createDataFrame(rows, SCHEMA), k=4, leaf=8)
    assert result(got) == [(i, 149, 0) for i in range(150)]


def test_links_across_saturated_groups(spark):
    """Two tight groups, every list full of its own group's links: the links across count."""
    r = np.random.default_rng(5)
    near, far = np.eye(16)[0], 0.95 * np.eye(16)[0] + np.sqrt(1 - 0.95**2) * np.eye(16)[1]
    rows = [(i, ((near if i < 40 else far) + r.normal(0, 0.004, 16)).astype(np.float32).tolist(), 1) for i in range(80)]
    got = linked_components(spark.createDataFrame(rows, SCHEMA), audit=0, retries=0)
    assert result(got) == brute(rows, 0.93) == [(i, 79, 0) for i in range(80)]


def test_saturated_components_are_searched_again(spark):
    """Links that no leaf or join has met are found by lists from outside the component."""
    from ledgerframe.llm.embedding_dedup import _bridged, _prepare

    r = np.random.default_rng(6)
    near, far = np.eye(16)[0], 0.95 * np.eye(16)[0] + np.sqrt(1 - 0.95**2) * np.eye(16)[1]
    rows = [(i, ((near if i < 40 else far) + r.normal(0, 0.004, 16)).astype(np.float32).tolist(), 1) for i in range(80)]
    nodes = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "cast(label as long) label", "embedding").mapInArrow(_prepare(4, 1, "<f4"), "vec_id long, label long, dim int, raw binary, codes array<long>").withColumnRenamed("vec_id", "node")
    edges = spark.createDataFrame([(i, i // 40 * 40 + (i + j) % 40, 0.99, False, j) for i in range(80) for j in (1, 2, 3)], "u long, v long, sim double, link boolean, r int")
    joined = spark.createDataFrame([(i, i // 40 * 40) for i in range(80)], "node long, component long")
    got = _bridged(edges, nodes, joined, 3, 0.72, 0.93, "<f4", 4, 64, 2)
    assert {(x.node, x.component) for x in got.collect()} == {(i, 0) for i in range(80)}


def pairs_beside_a_crowd(n=300, pairs=200, d=16):
    """One group of differing near copies, and pairs with one link each."""
    r = np.random.default_rng(7)
    base, rows = r.normal(size=d), []
    for i in range(n):
        rows.append((i, (base + r.normal(0, 0.02, d)).astype(np.float32).tolist(), 1))
    for i in range(n, n + 2 * pairs, 2):
        v = r.normal(size=d)
        rows += [(i + j, (v + r.normal(0, 0.05, d)).astype(np.float32).tolist(), 1) for j in range(2)]
    return rows


def test_missed_small_groups_lower_the_recall(spark):
    """All links of a crowd are found, no link of the pairs: recall is not near 1."""
    from ledgerframe.llm.embedding_dedup import _audited, _prepare

    nodes = spark.createDataFrame(pairs_beside_a_crowd(), SCHEMA).selectExpr("vec_id", "cast(label as long) label", "embedding").mapInArrow(_prepare(1, 1, "<f4"), "vec_id long, label long, dim int, raw binary, codes array<long>").withColumnRenamed("vec_id", "node")
    joined = spark.createDataFrame([(i, 0) for i in range(300)], "node long, component long")
    missed, score = _audited(nodes, joined, 0.93, "<f4", 512, 0)
    assert score < 0.01 and missed.count() > 200


def test_labels_with_missed_links_are_compared_whole(spark):
    """Trees that find nearly nothing, no local joins, no retries: all links come in the end."""
    rows, report = pairs_beside_a_crowd(60, 60), {}
    got = linked_components(spark.createDataFrame(rows, SCHEMA), trees=1, leaf=1, rounds=0, retries=0, audit=40, report=report)
    assert result(got) == brute(rows, 0.93)
    assert report["recall"][0] < 0.9 and report["recall"][-1] == 1.0


def test_crowded_leaf_keeps_near_nodes_together(spark):
    """One crowded leaf: most near pairs of it meet within the part they are dealt to."""
    from ledgerframe.llm.embedding_dedup import _leaves, _prepare
    import pyarrow as pa

    r = np.random.default_rng(8)
    base = r.normal(size=16)
    rows = []
    for i in range(0, 800, 2):
        v = base + r.normal(0, 0.01, 16)
        rows += [(i + j, (v + r.normal(0, 0.0001, 16)).astype(np.float32).tolist(), 1) for j in range(2)]
    nodes = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "cast(label as long) label", "embedding").mapInArrow(_prepare(1, 1, "<f4"), "vec_id long, label long, dim int, raw binary, codes array<long>").selectExpr("vec_id as node", "label", "dim", "raw", "array(0L) as codes", "vec_id as component")

    def met(table):
        node = {*table.column("node").to_pylist()}
        return pa.table({"n": pa.array([len(node)], pa.int64()), "pairs": pa.array([sum(i % 2 == 0 and i + 1 in node for i in node)], pa.int64())})

    got = _leaves(nodes, 0, 1, 8, "<f4").applyInArrow(met, "n long, pairs long").collect()
    assert max(g.n for g in got) < 100 and sum(g.n for g in got) == 800
    assert sum(g.pairs for g in got) > 350


def test_no_vectors(spark):
    assert linked_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert result(linked_components(spark.createDataFrame([(1, None, 1), (2, [1.0], None), (None, [1.0], 1)], SCHEMA))) == [(-1, 0, -1), (1, 0, 1), (2, 0, 2)]


def test_doubles(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 1e-9], 1), (3, [0.0, 1.0], 1)]
    assert result(linked_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_huge_and_tiny_vectors(spark):
    """Components whose squares overflow or vanish: finite, not zero, so they link."""
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1e200], 1), (3, [3e-200, 3e-200], 1), (4, [5e-324, 5e-324], 1), (5, [float("inf"), 1.0], 1), (6, [1e308, -1e308], 1), (7, [0.0, -0.0], 1)]
    got = linked_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    assert result(got) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 0, 6), (7, 0, 7)]


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = vectors(n=40)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("node", "raw", "dim", "codes", "component", "component_id", "n_links", "kept", "rep", "copies", "a", "b", "u", "v", "sim")})
    assert result(linked_components(docs)) == brute(rows, 0.93)
