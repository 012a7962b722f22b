"""Line dedup, spelling variants and collocations against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerframe.llm.collocations import collocations, frequent_phrases
from ledgerframe.llm.line_dedup import _later, first_lines, keep_flags
from ledgerframe.llm.spelling_variants import _count_words, _deletions, roots, spelling_variants

from .data import LONG, SCHEMA, clashing, corpus, frame

BLANK = "\t\n\x0b\x0c\r "
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lined():
    """The awkward corpus with lines that repeat, within and across documents."""
    rows = []
    for k, (i, t, *rest) in enumerate(corpus()):
        if t is not None and k % 2:
            t = f"{t}\n  Shared LINE of many\t\nshort\n{t}\r\né{'ü' * (8 + k % 4)}\n\n{' ' * 12}\nshared line of many"
        rows.append((i, t, *rest))
    return rows


def brute_lines(rows, least):
    last = 2**63 - 1
    docs = [(last if i is None else i, (t or "").split("\n")) for i, t, *_ in rows]
    first = {}
    for i, lines in docs:
        for x in lines:
            k = x.strip(BLANK).translate(LOW)
            first[k] = min(first.get(k, last), i)
    out = []
    for i, lines in docs:
        keep = [len(k) < least or first[k] >= i for k in (x.strip(BLANK).translate(LOW) for x in lines)]
        kept = "\n".join(x for x, y in zip(lines, keep) if y)
        out.append((-1 if i == last else i, len(lines), len(lines) - sum(keep), kept, tuple(keep)))
    return sorted(out)


@pytest.mark.parametrize("least,chunk", [(10, 1 << 20), (10, 200), (1, 2000)])
def test_first_lines(spark, least, chunk):
    got = first_lines(clashing(frame(spark, lined())), least, chunk_bytes=chunk, range_bytes=5000, with_text=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text, tuple(keep_flags(r.keep, r.n_lines).tolist())) for r in got) == brute_lines(lined(), least)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_first_lines_of_nothing_and_of_long_texts(spark):
    assert first_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "\n".join(f"a line of its own {k} " + LONG[:2000] for k in range(1500))
    got = first_lines(spark.createDataFrame([(2, long, "", "", 0), (1, long + "\nend of the text", "", "", 0), (3, "x" * 3_000_000, "", "", 0)], SCHEMA), chunk_bytes=1 << 16).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got) == [(1, 1501, 0), (2, 1500, 1500), (3, 1, 0)]


def test_a_stream_carries_the_first_occurrence_over_batches():
    rows = [(1, 0, 5), (1, 0, 5), (1, 0, 7), (1, 1, 9), (2, 0, 3), (2, 0, 4), (2, 0, 4)]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pydict(dict(zip(("key", "more", "doc"), map(np.array, zip(*rows[i : i + size])))) | {"chunk": np.arange(i, i + len(rows[i : i + size])), "k": np.zeros(len(rows[i : i + size]), np.int32)}) for i in range(0, len(rows), size)]
        assert [c for b in _later(iter(batches)) for c in b.column("chunk").to_pylist()] == [2, 5, 6]


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, shortest, least, ratio, every):
    n = Counter()
    for i, t, *_ in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    close = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(c, key=lambda v: (-n[v], v)) for w, c in close.items() if c}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def spelled():
    """Words, their variants with fewer occurrences, runs of equal letters, letters beyond ASCII, ties."""
    words = {"programme": 400, "program": 40, "programm": 30, "progrm": 2, "prógramme": 3, "prôgramme": 3, "aaaaaaaa": 50, "aaaaaaa": 4, "aaaaaaaaa": 2, "aabaaaaa": 2, "colour": 90, "color": 9, "ÀÉÎÕÜßÿ": 20, "ÀÉÎÕÜßÿa": 2, "ÀÉÎÕÜß": 2, "x×÷y×÷z": 3, "abcdefg": 7, "bacdefg": 7, "acbdefg": 70, "Abcdefgh": 700}
    text = [w for w, k in words.items() for _ in range(k)]
    return [(i, " ".join(text[i::7]), "en", "s", 0) for i in range(7)] + [(None, "Programme, prógramme-colour", "en", "s", 0), (8, None, "en", "s", 0), (9, "", "en", "s", 0)]


@pytest.mark.parametrize("rows", [corpus(), spelled()], ids=["corpus", "spelled"])
@pytest.mark.parametrize("shortest,least,ratio,every", [(7, 2, 10, 31), (2, 1, 2, 3)])
def test_spelling_variants(spark, rows, shortest, least, ratio, every):
    got = sorted(map(tuple, spelling_variants(clashing(frame(spark, rows)), shortest, least, ratio, every).collect()), key=str)
    assert got == brute_variants(rows, shortest, least, ratio, every)


def test_chains_of_forms_reach_their_roots(spark):
    chain = [(k, k + 1) for k in range(17)] + [(100, 5), (101, 100), (200, 201)]
    got = {r.id: r.root_id for r in roots(spark.createDataFrame(chain, "id long, form_id long")).collect()}
    assert got == {k: 17 for k in range(17)} | {100: 17, 101: 17, 200: 201}
    assert roots(spark.createDataFrame([], "id long, form_id long")).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], SCHEMA), ratio=1)


def test_long_words_and_nothing(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    one = "ab" * 150_000
    got = spelling_variants(spark.createDataFrame([(1, f"{one} {one}x {one} {one}x", "", "", 0)] * 11, SCHEMA), every=10**9)
    assert sorted((len(r.word), r.n, r.n_near) for r in got.collect()) == [(300_000, 22, 1), (300_001, 22, 1)]


def test_deletions_are_the_distinct_ones():
    words = ["aab", "abab", "éé", "x"]
    row, key, low, high = _deletions(words)
    by = defaultdict(set)
    for r, k, lo, hi in zip(row.tolist(), key.tolist(), low.tolist(), high.tolist()):
        if hi < 100:
            assert len({words[r][:p] + words[r][p + 1 :] for p in range(lo, hi + 1)}) == 1
            by[k].add(words[r][:lo] + words[r][lo + 1 :])
        else:
            by[k].add(words[r])
    assert all(len(texts) == 1 for texts in by.values())
    assert {t for x in by.values() for t in x} == {w[:p] + w[p + 1 :] for w in words for p in range(len(w))} | set(words)


def test_counts_are_given_out_before_they_grow():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["aaaaaaa bbbbbbb", "aaaaaaa", "ccccccc"]})
    out = list(_count_words(7, 10**9, held=2)(iter([batch])))
    assert [b.to_pydict() for b in out] == [{"word": ["aaaaaaa", "bbbbbbb"], "n": [1, 1]}, {"word": ["aaaaaaa", "ccccccc"], "n": [1, 1]}]


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang in n:
        count = f[lang]
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        held = defaultdict(int)
        for p, a in found.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    held[p[k : k + m]] = max(held[p[k : k + m]], a)
        scored = []
        for p, a in found.items():
            if 100 * held[p] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for k, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, k, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrased():
    """Few words, so that phrases repeat, in several languages, with pieces and awkward rows."""
    import random

    r = random.Random(5)
    common = ["the", "of", "é日本", "new"]
    rows = []
    for i in range(120):
        words = [r.choice(common) if r.random() < 0.6 else f"w{r.randrange(12)}" for _ in range(r.randint(0, 60))]
        text = " ".join(w + r.choice(["", "", "", ",", ".\n", "\t", " ;"]) for w in words) + " New York City of the" * (i % 3)
        rows.append((i, text, r.choice(["en", "de", None, "und", ""]), "s", 0))
    return rows + [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "of the new " * 40, "de", "s", 0), (4, None, "fr", "s", 0)] + corpus()


@pytest.mark.parametrize("least,top,sizes", [(30, 2000, {}), (3, 7, {"chunk_bytes": 500, "task_rows": 50}), (2, 2000, {"chunk_bytes": 4000, "task_rows": 300})])
def test_collocations(spark, least, top, sizes):
    rows = phrased()
    got = collocations(clashing(frame(spark, rows)), least, top, **sizes).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, least, top)


def test_prefixes_of_frequent_words_are_dealt_on(spark):
    """One phrase makes up nearly all pointers; its tasks' parts add up."""
    rows = [(i, "a a a a a a a a b", "en", "s", 0) for i in range(300)]
    words, phrases, _ = frequent_phrases(frame(spark, rows), 30, chunk_bytes=200, task_rows=20)
    names = {r.code: r.word for r in words.collect()}
    assert any(code % 2 for code in names)
    want = {"a": 2400, "b": 300, "a a": 2100, "a b": 300, "a a a": 1800, "a a b": 300, "a a a a": 1500, "a a a b": 300}
    assert {" ".join(names[c] for c in r.path): r.f for r in phrases.collect()} == want


def test_collocations_of_nothing_and_of_long_texts(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, "", 0), (2, "...", "", "", 0)], SCHEMA)).collect() == []
    got = collocations(spark.createDataFrame([(1, LONG * 20, "la", "", 0)], SCHEMA), chunk_bytes=1 << 16).collect()
    assert sorted(map(tuple, got)) == brute_collocations([(1, LONG * 20, "la")], 30, 2000)
