"""Near-duplicate and substring dedup against brute force."""

import hashlib
import re

import pytest

from ledgerframe.llm.components import components
from ledgerframe.llm.minhash_dedup import _intersections, match_threshold, near_duplicates
from ledgerframe.llm.substring_dedup import repeated_passages

from .data import LONG, SCHEMA, clashing, corpus, frame

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, n):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t, *_ in rows]
    known = [(i, s) for i, s in sets if i is not None]
    links = [(a, b) for k, (a, s) in enumerate(known) for b, t in known[:k] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    least = least_reachable({i for i, _ in known}, links)
    return sorted((i if i is not None else -1, len(s), least.get(i, -1), i is None or least[i] == i) for i, s in sets)


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in df.collect())


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, n, percent):
    assert found(near_duplicates(clashing(frame(spark)), n, percent)) == brute_components(corpus(), n, percent)


def test_large_postings_lose_no_link(spark):
    """A group of mutual near copies of many distances, compared in small blocks."""
    import random

    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(60)] = f"x{r.randrange(400)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85, small=4, block_bytes=1 << 12)
    assert found(got) == brute_components(rows, 3, 85)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert found(near_duplicates(spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0)], SCHEMA))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_intersections_match_sets():
    import numpy as np

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(50)]
    got = _intersections(sets, dense_from=8, columns=7)
    assert all(got[i, j] == len({*a.tolist()} & {*b.tolist()}) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_match_threshold_grows_with_similarity():
    assert 1 <= match_threshold(64, 50) < match_threshold(64, 85) < 64


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (7, 7), (None, 5), (4, 1), (1, 2)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_passages(rows, n):
    last = 2**63 - 1
    docs = [(i, SPACED.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            first[x] = min(first.get(x, last), last if i is None else i)
    out = []
    for i, w in docs:
        lost = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (last if i is None else i):
                lost[k : k + n] = [True] * n
        kept = " ".join(x for x, gone in zip(w, lost) if not gone)
        out.append((-1 if i is None else i, len(w), sum(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n,chunk", [(13, 1 << 20), (13, 300), (4, 1000)])
def test_repeated_passages(spark, n, chunk):
    got = repeated_passages(clashing(frame(spark)), n, chunk_bytes=chunk).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(corpus(), n)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_passages_of_nothing(spark):
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []
    one = repeated_passages(spark.createDataFrame([(1, LONG, "", "", 0)], SCHEMA), with_text=False).collect()
    assert (one[0].n_words, one[0].n_removed) == (18000, 0)
