"""Words, hashes and windows of Arrow text columns, as numpy arrays.

All functions work on the UTF-8 bytes of an Arrow string column, so no Python
string is made per word.  Word classes that are ASCII sets or their complements
are the same on bytes as on code points, since every byte of a multi-byte
character is 0x80 or higher.

Words are identified by 64-bit hashes.  Two different words of one corpus of
ten million distinct words collide with a probability of about 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_ALL = U(0xFFFFFFFFFFFFFFFF)

#: Bytes of words for each class of words that the contracts use.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def multipliers(n: int, seed: int = 0) -> np.ndarray:
    """n odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1000)) * _M1) | U(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null has no bytes."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many text bytes, or one row if that is longer."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of some texts: byte positions, hashes and bounds by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        if lower:
            data = LOWER[data]
        self.data, self.offsets, n = data, offsets, len(data)
        inside = kind[data]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            cuts = offsets[(offsets > 0) & (offsets < n)]
            before[cuts] = False
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after[cuts - 1] = False
            self.starts = np.flatnonzero(inside & ~before)
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, taken eight at a time."""
        n = len(self.data)
        wide = np.lib.stride_tricks.as_strided(np.concatenate([self.data, np.zeros(8, np.uint8)]).view(np.uint8), (n + 1, 8), (1, 1))
        lengths = self.ends - self.starts
        with np.errstate(over="ignore"):
            h = lengths.astype(U) * _M1
            at, left, which = self.starts, lengths, None
            while len(at):
                part = np.ascontiguousarray(wide[at]).view(np.uint64).ravel()
                short = left < 8
                keep = np.where(short, (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1), _ALL)
                now = mix(((h if which is None else h[which]) ^ (part & keep)) * _M3 + _M1)
                if which is None:
                    h = now
                else:
                    h[which] = now
                on = np.flatnonzero(left > 8)
                at, left, which = at[on] + 8, left[on] - 8, on if which is None else which[on]
        return h

    def windows(self, h: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start index and hash of every window of n words inside one text."""
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, U)
        with np.errstate(over="ignore"):
            total = np.zeros(len(h) - n + 1, U)
            for i, m in enumerate(multipliers(n, seed)):
                total += h[i : len(h) - n + 1 + i] * m
            total = mix(total)
        last = np.repeat(self.bounds[1:], self.counts)[: len(total)]
        at = np.arange(len(total))
        ok = at + n <= last
        return (at, total) if ok.all() else (at[ok], total[ok])


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + length, -1)
    return np.cumsum(edge[:-1]) > 0
