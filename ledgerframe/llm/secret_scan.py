"""Secrets in documents: fixed patterns, and a linear-chain conditional random field.

The field tags the tokens of a line as begin, inside or outside of a secret.
Its features are a token's shape (length, digits, cases, hex, class changes,
known prefixes), neighbouring words (secret keywords before it, lengths next to
it, the delimiter before it, a dot or equals sign that joins it to a neighbour) and
a file feature (share of code-like tokens).  It is trained by maximum likelihood
(forward-backward, Adam) on generated lines that hold secrets of many kinds and on a
bounded sample of the corpus's own lines: what the patterns match there is a secret,
and a line with a token that looks like one and that they do not match is left out,
for it is no proof of either.  Lines are decoded by Viterbi.  A line where no token
can gain from leaving "outside", whatever the transitions, needs no decoding:
outside throughout is its best path.

Training reads the documents twice to draw its sample (hashes of texts, then the
lines of a bounded number of texts); the scan is one pass without a shuffle, with a
model of a few kilobytes.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import carried, fields_of
from ._words import LOWER, U, Words, buffers, pieces

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-", *range(0x80, 0x100)]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_KIND = np.zeros(256, np.uint8)  # 1 digit, 2 upper, 3 lower, 4 symbol of a token, 5 beyond ASCII
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[list(b"+/_-")], _KIND[0x80:] = 1, 2, 3, 4, 5
_COUNT = np.zeros(256, np.uint64)  # digits, upper and lower letters in 21 bits each
for _k, _shift in ((1, 0), (2, 21), (3, 42)):
    _COUNT[_KIND == _k] = U(1) << U(_shift)
_MORE = np.zeros(256, np.uint64)  # hex digits, symbols
_MORE[_HEX] = U(1)
_MORE[_KIND == 4] = U(1) << U(42)
_FIELD = U((1 << 21) - 1)
_DELIMITER = np.zeros(256, np.uint8)
_DELIMITER[list(b"=:")] = 1
_DELIMITER[list(b"\"'`")] = 2
_LENGTHS = np.array([4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
_KEYWORDS = [b"password", b"passwd", b"pwd", b"passphrase", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"key", b"auth", b"authorization", b"bearer", b"credential", b"credentials", b"access_key", b"private_key", b"client_secret", b"access_token"]
_PREFIXES = [b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghs_", b"xoxb", b"xoxp", b"AIza", b"eyJh", b"sk-", b"pk_", b"sk_"]
#: Values of each feature, in the order of ``features``.
SIZES = (11, 6, 8, 4, 5, 2, 3, 2, 2, 4, 11, 11, 3, 3, 3)
#: A token can only be inside a secret if a dot or equals sign joins it to the one before.
GLUE = 13
_JOINED = np.zeros((SIZES[GLUE], 3))
_JOINED[0, 2] = -30.0
#: Lines are cut to so many tokens for training.
CHAIN = 60


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.sort(Words(*buffers(pa.array(words, pa.binary())), _TOKEN, True).hashes())


_KEYWORD_HASHES = _word_hashes(_KEYWORDS)


def _member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature values (features, tokens) and the line of each token."""
    n, data = len(w), w.data
    if not n:
        return np.zeros((len(SIZES), 0), np.uint8), np.zeros(0, np.int64)
    length = w.ends - w.starts
    kind = _KIND[data]
    changes = np.zeros(len(data), U)
    changes[1:][(kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)] = U(1) << U(21)
    a = np.add.reduceat(_COUNT[data], w.starts)
    b = np.add.reduceat(_MORE[data] + changes, w.starts)
    digit, upper, lower = ((a >> U(s) & _FIELD).astype(np.int64) for s in (0, 21, 42))
    hexes, change, symbol = ((b >> U(s) & _FIELD).astype(np.int64) for s in (0, 21, 42))
    bucket = np.searchsorted(_LENGTHS, length, "right").astype(np.uint8)
    share = digit / length
    digits = np.where(digit == 0, 0, np.where(digit == length, 5, 1 + np.searchsorted([0.15, 0.35, 0.6], share)))
    case = (digit > 0) + 2 * (upper > 0) + 4 * (lower > 0)
    hexed = np.where(hexes == length, np.where(digit > 0, np.where(length >= 16, 3, 2), 1), 0)
    rate = np.where(change == 0, 0, 1 + np.searchsorted([0.1, 0.25, 0.4], change / length))
    foreign = digit + upper + lower + symbol < length
    # Lines, and the delimiter before each token.
    breaks = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(breaks, w.starts) + np.repeat(np.arange(len(w.counts)), w.counts)
    same = np.zeros(n, bool)
    same[1:] = line[1:] == line[:-1]
    mark = _DELIMITER[data]
    one = mark[np.maximum(w.starts - 1, 0)]
    two = mark[np.maximum(w.starts - 2, 0)]
    three = mark[np.maximum(w.starts - 3, 0)]
    gap = np.concatenate([[0], w.starts[1:] - w.ends[:-1]])
    equals = (one == 1) | ((gap > 1) & (two == 1)) | ((gap > 2) & (three == 1))
    quoted = one == 2
    delimiter = np.where(same & (gap <= 5), equals + 2 * quoted, 2 * quoted)
    keyword = _member(Words.hashes(_lowered(w)), _KEYWORD_HASHES)
    before = np.zeros(n, bool)
    before[1:] = keyword[:-1] & same[1:]
    second = np.zeros(n, bool)
    second[1:] = before[:-1] & same[1:]
    head = np.zeros(n, np.int64)
    quad = data[np.minimum(w.starts[:, None] + np.arange(4), len(data) - 1)]
    for p in _PREFIXES:
        head[(quad[:, : len(p)] == np.frombuffer(p, np.uint8)).all(axis=1) & (length > len(p) + 8)] = 1
    head[keyword] = 2
    after = np.zeros(n, np.uint8)
    after[:-1] = np.where(same[1:], bucket[1:], 0)
    prior = np.zeros(n, np.uint8)
    prior[1:] = np.where(same[1:], bucket[:-1], 0)
    code = (digit > 0) & (lower + upper > 0)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    codes = np.bincount(doc, weights=code, minlength=len(w.counts)) / np.maximum(w.counts, 1)
    file = np.searchsorted([0.02, 0.2], codes)[doc]
    last = data[np.maximum(w.starts - 1, 0)]
    glue = np.where(same & (gap == 1), np.where(last == 0x2E, 1, np.where(last == 0x3D, 2, 0)), 0)
    onward = np.append(glue[1:], 0)
    out = (bucket, digits, case, hexed, rate, foreign, head, before, second, delimiter, after, prior, file, glue, onward)
    return np.stack([x.astype(np.uint8) for x in out]), line


def _lowered(w: Words) -> Words:
    out = object.__new__(Words)
    out.__dict__.update(w.__dict__)
    out.data = LOWER[w.data]
    return out


class Field:
    """Weights of the chain: tags are 0 outside, 1 begin, 2 inside."""

    def __init__(self, tables: list[np.ndarray], moves: np.ndarray, start: np.ndarray):
        self.tables, self.moves, self.start = tables, moves, start

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = self.tables[0][f[0]]
        for t, x in zip(self.tables[1:], f[1:], strict=True):
            out = out + t[x]
        return out

    def decode(self, f: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best tags of all lines."""
        tags = np.zeros(len(line), np.int8)
        if not len(line):
            return tags
        e = self.emissions(f)
        # What a token gains at most by not being outside, all transitions in its favour.
        bonus = self.moves.max() - self.moves[0, 0]
        worth = e[:, 1:].max(axis=1) - e[:, 0] + 2 * max(bonus, 0) + max(0, (self.start[1:] - self.start[0]).max()) > 0
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        size = np.diff(np.append(begin, len(line)))
        use = np.flatnonzero(np.logical_or.reduceat(worth, begin))
        use = use[np.argsort(-size[use], kind="stable")]
        if not len(use):
            return tags
        begin, size = begin[use], size[use]
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        score = self.start + e[begin]
        back = []
        for t in range(1, int(size[0])):
            k = int(active[t])
            step = score[:k, :, None] + self.moves
            back.append(step.argmax(axis=1).astype(np.int8))
            score[:k] = step.max(axis=1) + e[begin[:k] + t]
        now = score.argmax(axis=1)
        tags[begin + size - 1] = now
        for t in range(int(size[0]) - 1, 0, -1):
            k = int(active[t])
            now[:k] = back[t - 1][np.arange(k), now[:k]]
            tags[begin[:k] + t - 1] = now[:k]
        return tags


def fit(f: np.ndarray, line: np.ndarray, tags: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam; of a longer line each ``CHAIN`` tokens are a chain."""
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(begin, len(line)))
    parts = -(-size // CHAIN)
    within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, size = np.repeat(begin, parts) + within * CHAIN, np.minimum(np.repeat(size, parts) - within * CHAIN, CHAIN)
    tags = tags.copy()
    tags[begin[tags[begin] == 2]] = 1
    tags[(tags == 2) & (f[GLUE] == 0)] = 1
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    offsets = np.concatenate([[0], np.cumsum(SIZES)])
    params = {"w": np.zeros((offsets[-1], 3)), "m": np.zeros((3, 3)), "s": np.zeros(3)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    forbidden = np.zeros((3, 3))
    forbidden[0, 2] = -30.0  # inside never follows outside
    # Tokens with equal features share their scores and gradients.
    combos, combo = np.unique(f.T, axis=0, return_inverse=True)
    combo = combo.ravel()
    flat = combos.T.astype(np.int64) + offsets[:-1, None]
    used = np.concatenate([begin[: active[t]] + t for t in range(steps)])  # step by step
    at = np.concatenate([[0], np.cumsum(active)])
    truth = {"w": np.zeros_like(params["w"]), "m": np.zeros((3, 3)), "s": np.bincount(tags[begin], minlength=3).astype(float)}
    combo = combo[used]
    by_combo = np.bincount(combo * 3 + tags[used], minlength=3 * len(combos)).reshape(-1, 3)
    for row in flat:
        np.add.at(truth["w"], row, by_combo)
    for t in range(1, steps):
        np.add.at(truth["m"], (tags[begin[: active[t]] + t - 1], tags[begin[: active[t]] + t]), 1)

    for it in range(1, rounds + 1):
        e = sum(params["w"][row] for row in flat) + _JOINED[combos[:, GLUE]]
        moves, start = np.exp(params["m"] + forbidden), params["s"] + np.array([0, 0, -30.0])
        likely = np.exp(e - e.max(axis=1, keepdims=True))[combo]
        # Forward and backward by probabilities, scaled at each step.
        scaled = lambda x: (x / x.sum(axis=1, keepdims=True), x.sum(axis=1, keepdims=True))
        alpha, total = [], []
        for t in range(steps):
            k = active[t]
            a, n = scaled((alpha[-1][:k] @ moves if t else np.exp(start - start.max())) * likely[at[t] : at[t + 1]])
            alpha.append(a)
            total.append(n)
        beta = np.ones((len(begin), 3))
        grad = {"w": np.zeros_like(params["w"]), "m": np.zeros((3, 3)), "s": np.zeros(3)}
        p = np.zeros((len(combo), 3))
        for t in range(steps - 1, -1, -1):
            k = active[t]
            p[at[t] : at[t + 1]] = alpha[t] * beta[:k]
            if t:
                inner = likely[at[t] : at[t + 1]] * beta[:k] / total[t]
                grad["m"] += moves * (alpha[t - 1][:k].T @ inner)
                beta[:k] = inner @ moves.T
        grad["s"] = p[: len(begin)].sum(axis=0)
        for tag in range(3):
            mass = np.bincount(combo, weights=p[:, tag], minlength=len(combos))
            for row in flat:
                grad["w"][:, tag] += np.bincount(row, weights=mass, minlength=offsets[-1])
        for k, v in params.items():
            g = (truth[k] - grad[k]) / len(begin) - penalty * v
            m1, m2 = moment[k]
            m1[:] = 0.9 * m1 + 0.1 * g
            m2[:] = 0.99 * m2 + 0.01 * g * g
            v += rate * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.99**it)) + 1e-9)
    tables = [params["w"][a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    tables[GLUE] = tables[GLUE] + _JOINED
    return Field(tables, params["m"] + forbidden, params["s"] + np.array([0, 0, -30.0]))


def generated(seed: int = 7, n: int = 1500) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with secrets, and where; and lines with harmless tokens of similar shape."""
    r = random.Random(seed)
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(2, 9)))
    of = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    out = []
    for _ in range(n):
        before, after = (" ".join(word() for _ in range(r.randint(0, 8))) for _ in range(2))
        if r.random() < 0.5:
            key = r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_token", "client_secret", "auth", "Bearer", "private_key", ""])
            value = r.choice([lambda: of(hexes, 20, 64), lambda: of(b64, 20, 60), lambda: "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: "ghp_" + of(b64[:62], 30, 36), lambda: "sk-" + of(b64[:62], 24, 48), lambda: "xoxb-" + of("0123456789", 10, 12) + "-" + of(b64[:62], 20, 24), lambda: of(b64[:62] + "_-", 10, 20) if key else of(b64[:62], 24, 40), lambda: ".".join(("eyJ" + of(b64[:62], 12, 30), of(b64[:62] + "_-", 30, 80), of(b64[:62] + "_-", 30, 50))), lambda: "SG." + of(b64[:62] + "_-", 18, 24) + "." + of(b64[:62] + "_-", 30, 44), lambda: of(b64, 26, 62) + "=" * r.randint(1, 2)])()
            glue = r.choice([" = ", "=", ": ", ":", ' = "', '="', '": "', " "]) if key and key != "Bearer" else " "
            line = f"{before} {key}{glue}".lstrip() if key else f"{before} ".lstrip()
            at = len(line)
            line += value
            spans = [(at, at + len(value))]
            if glue[-1] == '"':
                line += '"'
            out.append((f"{line} {after}", spans))
        else:
            item = r.choice([lambda: ".".join(word() for _ in range(r.randint(2, 4))) + "()", lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"www.{word()}.example.com/{word()}?{word()}={r.randint(1, 999)}&{word()}={word()}", lambda: f"{word()}={word()}", lambda: f"{word()}_{word()}.tar.gz", lambda: "-".join(of(hexes, n, n) for n in (8, 4, 4, 4, 12)), lambda: "".join(word().title() for _ in range(r.randint(2, 4))), lambda: f"{word()}{r.randint(0, 9999)}", lambda: f"{word()}.{r.randint(10, 99)}@mail{r.randint(0, 9)}.example.com", lambda: f"+1 ({of('0123456789', 3, 3)}) {of('0123456789', 3, 3)}-{of('0123456789', 4, 4)}", lambda: of("0123456789", 12, 19), lambda: of("0123456789", 1, 12), lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", lambda: f"https://{word()}.example.com/{word()}/{r.randint(1, 9999)}", lambda: f"{word()}_{word()}_{word()} = {r.randint(0, 99)}", lambda: f"{word()}.{word()}@{word()}.org", lambda: word().upper() + "-" + of("0123456789", 2, 5), lambda: f"+{of('0123456789', 2, 3)} {of('0123456789', 3, 4)} {of('0123456789', 3, 4)}", lambda: "".join(word() for _ in range(4)), lambda: f"{r.choice(['token', 'secret', 'password', 'key'])} {word()} {word()}", lambda: f"{word()} = \"{word()} {word()}\"", lambda: f"{of('0123456789', 4, 4)} {of('0123456789', 4, 4)} {of('0123456789', 4, 4)} {of('0123456789', 4, 4)}"])()
            out.append((f"{before} {item} {after}", []))
    return out


def _hex_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    runs = Words(data, offsets, _HEX, False)
    long = runs.ends - runs.starts >= 24
    return runs.starts[long], runs.ends[long]


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value) of the patterns' matches in one text."""
    out = [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end(), m.start()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    return out


def _tagged(lines: list[tuple[str, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [x.encode() for x, _ in lines]
    w = Words(*buffers(pa.array(raw, pa.binary())), _TOKEN, False)
    f, line = features(w)
    tags = np.zeros(len(w), np.int64)
    for i, (text, spans) in enumerate(lines):
        for a, b in spans:
            a, b = (len(text[:x].encode()) + int(w.offsets[i]) for x in (a, b))
            inside = np.flatnonzero((w.starts >= a) & (w.ends <= b))
            tags[inside] = 2
            tags[inside[:1]] = 1
    return f, line, tags


def _lookalike(text: str, known: list[tuple[int, int]]) -> bool:
    """Whether a line holds something beside the known spans that might be a secret."""
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{10,}", text):
        x = m[0]
        mixed = bool(re.search("[0-9]", x)) + bool(re.search("[a-z]", x)) + bool(re.search("[A-Z]", x[1:]))
        if mixed >= 2 and not any(a < m.end() and m.start() < b for a, b in known):
            return True
    return False


def train(docs: DataFrame, sample_docs: int = 300, sample_lines: int = 2_000, line_chars: int = 400) -> Field:
    """A field for a corpus, from generated lines and a bounded sample of its own.

    The sample is ``sample_lines`` lines of the ``sample_docs`` texts that hash least;
    of a longer line each ``line_chars`` characters count as one.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    least = [r.h for r in texts.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample_docs).collect()]
    lines = []
    if least:
        of = texts.filter(F.xxhash64("text").isin(least)).select(F.explode(F.split("text", "\n")).alias("line"))
        cut = of.select(F.explode(F.regexp_extract_all("line", F.lit(rf".{{1,{line_chars}}}(?:\s|$)|\S{{{line_chars}}}"), F.lit(0))).alias("line"))
        drawn = cut.filter(F.trim("line") != "").distinct().orderBy(F.xxhash64("line"), "line").limit(sample_lines)
        lines = [r.line for r in drawn.collect()]
    own = [(x, [(v, b) for _, _, b, v in base_spans(x)]) for x in lines]
    return fit(*_tagged(generated() + [(x, spans) for x, spans in own if not _lookalike(x, spans)]))


def _scan(model, shard_bytes: int, with_text: bool, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = model.value
        for batch in batches:
            for piece in pieces(batch, "_text", shard_bytes):
                data, offsets = buffers(piece.column("_text"))
                found, added = _base_of_shard(data, offsets), {}
                w = Words(data, offsets, _TOKEN, False)
                f, line = features(w)
                tags = field.decode(f, line)
                begin = np.flatnonzero((tags == 1) | ((tags == 2) & (np.concatenate([[0], tags[:-1]]) == 0)))
                row = np.searchsorted(w.bounds, begin, "right") - 1
                for i, t in zip(row.tolist(), begin.tolist(), strict=True):
                    e = t
                    while e + 1 < len(tags) and tags[e + 1] == 2 and e + 1 < w.bounds[i + 1] and line[e + 1] == line[t]:
                        e += 1
                    a, b = int(w.starts[t] - offsets[i]), int(w.ends[e] - offsets[i])
                    padding = data[w.ends[e] : min(w.ends[e] + 2, offsets[i + 1])] == 0x3D
                    b += int(padding.cumprod().sum())
                    added.setdefault(i, []).append((a, "crf", b, a))
                for i, spans in added.items():
                    covering = _union(found.get(i, []))
                    found.setdefault(i, []).extend(x for x in spans if not _inside(x, covering))
                n = len(piece)
                counts = np.zeros((3, n), np.int64)
                empty = hashlib.sha256(b"").hexdigest()
                shas, spans_out, cleaned = [empty] * n, [""] * n, {}
                for i, spans in found.items():
                    raw = data[offsets[i] : offsets[i + 1]]
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
                    named = [f"{k}:{points[a]}:{points[b]}" for a, k, b, _ in spans]
                    for _, k, _, _ in spans:
                        if k != "crf":
                            counts[KINDS.index(k), i] += 1
                    shas[i] = hashlib.sha256(",".join(x for x in named if not x.startswith("crf")).encode()).hexdigest()
                    spans_out[i] = ",".join(named)
                    if with_text:
                        cleaned[i] = _redacted(raw.tobytes(), [(v, b) for _, _, b, v in spans])
                made = {**{c: piece.column(c) for c in kept}, **{f"n_{k}": pa.array(counts[j], pa.int64()) for j, k in enumerate(KINDS[:3])}, "base_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans_out, pa.string())}
                if with_text:
                    made["clean_text"] = pa.array([cleaned.get(i, t.as_py()) for i, t in enumerate(piece.column("_text"))], pa.string())
                yield pa.RecordBatch.from_pydict(made)

    return run


def _base_of_shard(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, str, int, int]]]:
    """The patterns' matches by document, in bytes; only documents with a literal of a pattern meet it."""
    found: dict[int, list[tuple[int, str, int, int]]] = {}
    at, to = _hex_runs(data, offsets)
    for i, a, b in zip((np.searchsorted(offsets, at, "right") - 1).tolist(), at.tolist(), to.tolist(), strict=True):
        found.setdefault(i, []).append((int(a - offsets[i]), "hex", int(b - offsets[i]), int(a - offsets[i])))
    for plain, keys, pattern, kind in ((LOWER[data].tobytes(), _KEYS, ASSIGN, "assign"), (data.tobytes(), (b"AKIA",), ACCESS, "access")):
        places = []
        for key in keys:
            k = plain.find(key)
            while k >= 0:
                places.append(k)
                k = plain.find(key, k + len(key))
        for i in np.unique(np.searchsorted(offsets, places, "right") - 1).tolist() if places else []:
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("latin-1")  # the patterns are ASCII: bytes serve as characters
            for m in pattern.finditer(text):
                if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= 20:
                    found.setdefault(i, []).append((m.start(), kind, m.end(), m.start(2) if kind == "assign" else m.start()))
    return found


def _union(spans: list[tuple[int, str, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs that spans cover together."""
    begins, ends = [], []
    for a, _, b, _ in sorted(spans):
        if begins and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def _inside(span: tuple[int, str, int, int], runs: tuple[list[int], list[int]]) -> bool:
    k = bisect_right(runs[0], span[0]) - 1
    return k >= 0 and span[2] <= runs[1][k]


def _redacted(raw: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [raw[at:a], b"[SECRET]"]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def scan_secrets(docs: DataFrame, model: Field | None = None, shard_bytes: int = 2 << 20, with_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Secrets in every whole text.

    ``docs`` has ``doc_id`` and ``text``.  Pattern spans are whole matches, in
    code points, end exclusive: ``assign`` (a keyword, an assignment and a value
    of 6 or more characters), ``access`` (AKIA keys of 20 or more), ``hex`` (24 or
    more hex digits).  Spans of the field have the kind ``crf``; one that pattern spans
    cover is left out.  Returns per row doc_id, carried (a struct of the columns of
    ``docs`` named by ``carry``, if any), n_assign, n_access, n_hex, base_sha256 (of
    the pattern spans as kind:start:end by start, then kind, comma-joined), spans
    (all, joined likewise), and with ``with_text`` clean_text, where secret values
    read ``[SECRET]``.

    Nulls: a null text is the empty text, and stays null in clean_text.  Empty texts
    have no spans.  Very long texts are scanned whole, a text longer than
    ``shard_bytes`` as a shard of its own.  Ties and repeats: spans that start
    together go by kind; rows that repeat an id are judged each for itself.  No
    documents give no rows (the field then comes from the generated lines).  Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or train(docs))
    head = docs.select("doc_id", *carried(docs, carry))
    rows = docs.select("doc_id", *carried(docs, carry), F.col("text").cast("string").alias("_text"))
    schema = fields_of(head, "n_assign long", "n_access long", "n_hex long", "base_sha256 string", "spans string", *["clean_text string"] * with_text)
    return rows.mapInArrow(_scan(sent, shard_bytes, with_text, head.columns), schema)
