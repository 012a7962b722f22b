import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerframe.llm._words import ALNUM, SPACED, Words, buffers, covered, pieces

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXT = st.text(alphabet="aB1 \t\n.é日\x00-", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(0, 3))
def test_words_are_the_pattern_s(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    texts = texts[min(skip, len(texts)) :]
    for kind, lower, pattern in ((SPACED, False, r"[^\x20\x09-\x0D]+"), (ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(*buffers(column), kind, lower)
        got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        assert got == [re.findall(pattern, (t or "").translate(LOW) if lower else t or "") for t in texts]


def test_hashes_tell_words_apart():
    words = sorted({f"{'x' * (i % 23)}{i}" for i in range(5000)} | {"a" * n for n in range(1, 60)})
    h = Words(*buffers(pa.array([" ".join(words)])), SPACED, False).hashes()
    assert len(set(h.tolist())) == len(words)
    again = Words(*buffers(pa.array(["zz " + " ".join(words)])), SPACED, False).hashes()
    assert (again[1:] == h).all()


def test_windows_stay_inside_texts():
    w = Words(*buffers(pa.array(["a b c", "a b", None, "a b c d"])), SPACED, False)
    at, h = w.windows(w.hashes(), 3)
    assert at.tolist() == [0, 5, 6] and h[0] == h[1] != h[2]
    assert len(w.windows(w.hashes()[:0], 3)[0]) == 0


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["aa", None, "b" * 50, "", "cc"])})
    got = [p.column("text").to_pylist() for p in pieces(batch, "text", 4)]
    assert [x for p in got for x in p] == ["aa", None, "b" * 50, "", "cc"] and max(map(len, got)) > 1


def test_covered():
    assert covered(6, np.array([0, 1, 4]), 2).tolist() == [True, True, True, False, True, True]
