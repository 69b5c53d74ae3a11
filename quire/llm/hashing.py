"""Vectorised hashing of the words of whole texts (numpy, no per-word Python).

A text is UTF-8; its words are maximal runs of bytes outside the six ASCII white-space
bytes, which is the word class ``[^\\x20\\x09-\\x0D]+``. A batch of texts is hashed at once:
each word gets a 64-bit value from a random byte table, a polynomial over its bytes and a
final mix, so equal words have equal values in every task and every run.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept, and grown by doubling."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.empty(size, U64), np.empty(size, U64)
        for out, step in ((up, _BASE), (down, _INV)):
            out[0] = 1
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U64(pow(step, done, 1 << 64))
                done *= 2
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column, feeds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, each text followed by line feeds, and where each text ends with them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and n else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    ends = np.cumsum(lengths + feeds)
    out = np.full(int(ends[-1]) if n else 0, 0x0A, np.uint8)
    if n:
        keep = np.ones(len(out), bool)
        for k in range(1, feeds + 1):
            keep[ends - k] = False
        out[keep] = data[offsets[0] : offsets[-1]]
    return out, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each span of the bytes, by their values and number alone; each seed has a byte table of its own."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, U64)
    table = mix(_TABLE + U64(seed)) if seed else _TABLE
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(table[data] * up[:n], out=sums[1:])
    value = (sums[stops] - sums[starts]) * down[starts]
    return mix(value ^ (stops - starts).astype(U64) * U64(0xA0761D6478BD642F))


class Words:
    """The words of a batch of texts: hash, byte span, and the first word of each text."""

    def __init__(self, column):
        self.bytes, self.ends = text_buffer(column)
        n = len(self.bytes)
        word = np.empty(n + 1, np.int8)
        word[0] = 0
        np.logical_not(_SPACE[self.bytes], out=word[1:].view(bool))
        step = np.diff(word)
        self.starts = np.flatnonzero(step == 1)
        # every text ends in a line feed, so each word that starts also ends
        self.stops = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, np.concatenate(([0], self.ends)))
        self.n_words = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.starts, self.stops)


def windows(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``size`` values, by its first; runs may cross texts, which the caller masks."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = U64(0xC2B2AE3D27D4EB4F if not seed else (0x165667B19E3779F9 + 2 * seed) | 1)
    total = np.full(n, U64(seed + 1), U64)
    for k in range(size):
        total *= base
        total += words[k : k + n]
    return mix(total)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """The starts of the runs of ``size`` words that lie in one text, and the text of each, as two arrays."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(len(owner)) + shift, owner
