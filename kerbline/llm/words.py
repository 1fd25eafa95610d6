"""Words of whole texts as 64-bit keys, computed over arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Text bytes handled at once, at least one text; arrays of about 40 times that are held.
CHUNK_BYTES = 1 << 20

# A word byte after lower-casing A-Z: digits, a-z and every byte of a character above ASCII.
_LOWER = np.zeros(256, np.uint64)
for _b in range(256):
    _c = _b + 32 if 0x41 <= _b <= 0x5A else _b
    if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80:
        _LOWER[_b] = _c
_IS_WORD = _LOWER > 0

_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; ``base`` is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            run = np.full(size, b, np.uint64)
            run[0] = 1
            both.append(np.multiply.accumulate(run))
        have = tuple(both)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit key of each 64-bit number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: key and byte length of each, and where each text's words begin."""

    keys: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    def windows(self, size: int, seed: int = 0x2545F4914F6CDD1D) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all runs of ``size`` words, and the place of the first word of each."""
        n = len(self.keys) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total, factor = np.zeros(n, np.uint64), 1
        for j in range(size):
            total += self.keys[j : j + n] * np.uint64(factor)
            factor = factor * seed & (2**64 - 1)
        # Runs that would reach into the next text do not count.
        inside = np.ones(n, bool)
        for j in range(1, size):
            edges = self.first[1:-1] - j
            inside[edges[(edges >= 0) & (edges < n)]] = False
        at = np.flatnonzero(inside)
        return mixed(total[at]), at


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes)."""
    n = len(data)
    inside = _IS_WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(_BASE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * up, out=sums[1:])
    lengths = ends - starts
    keys = mixed((sums[ends] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
    return Words(keys, lengths, np.searchsorted(starts, offsets, side="left"))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, offsets = text_bytes(texts)
    begin, n = 0, len(offsets) - 1
    while begin < n:
        to = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        to = min(n, max(begin + 1, to))
        yield begin, to, data[offsets[begin] : offsets[to]], offsets[begin : to + 1] - offsets[begin]
        begin = to
