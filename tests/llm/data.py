"""Small corpora with the awkward rows that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 6000


def word(r):
    return "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))


def corpus(seed=1, n=60):
    """Random texts, copies, near copies, nulls, blanks, a long text, repeated ids and rows."""
    r = random.Random(seed)
    texts = [" ".join(word(r) for _ in range(r.randint(1, 80))) for _ in range(n)]
    for _ in range(n // 2):
        base = r.choice(texts).split()
        for _ in range(r.randint(0, 2)):
            base[r.randrange(len(base))] = word(r)
        texts.append(" ".join(base))
    texts += [texts[0], texts[0], texts[1].upper(), None, None, "", "   \n\t", "one", "one", "two words", LONG, LONG + "end", "é日本 ß " * 30]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (rows[7][0], "another text of an id that repeats"), (None, texts[2]), (None, None)]
    r.shuffle(rows)
    return [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def clashing(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("a", "b", "node", "key", "score", "spans", "items", "hits", "n_words", "component", "rep", "length", "kept", "path2", "u", "v")})
