"""Words of many texts at once: their places and hashes in one array of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # bytes of text that are worked on together

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
IN_WORD[65:91] = True  # lowered first
# Everything but white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[9:14] = NOT_SPACE[32] = False
BASE, STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so the first has an inverse
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n-1, modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, SLICE + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


class Words:
    """The words of some texts in one byte array: places, texts they are of, and hashes."""

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, kind: np.ndarray = IN_WORD):
        """``first`` and ``last`` are the bounds of each text in ``data``; ``kind`` says which
        bytes words are made of."""
        self.low = LOWER[data]
        inside = kind[data]
        before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        before[1:], after[:-1] = inside, np.append(inside[1:], False)
        before[first], after[last - 1] = False, False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[:-1]) + 1
        self.text = np.searchsorted(first, self.start, "right") - 1
        summed = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.low * powers(BASE, len(data)), out=summed[1:])
        self.hash = (summed[self.end] - summed[self.start]) * powers(INVERSE, len(data) + 1)[self.start]

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they are of one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out, factor = np.zeros(n, np.uint64), 1
        for k in range(size):
            out += self.hash[k : k + n] * np.uint64(factor)
            factor = factor * STEP % (1 << 64)
        out ^= out >> np.uint64(31)
        out *= np.uint64(BASE)
        out ^= out >> np.uint64(29)
        return out, self.text[:n] == self.text[size - 1 :]

    def string(self, first: int, last: int) -> str:
        low = self.low
        return b" ".join([low[s:e].tobytes() for s, e in zip(self.start[first:last].tolist(), self.end[first:last].tolist())]).decode()


def slices(column: pa.Array, kind: np.ndarray = IN_WORD) -> Iterator[tuple[int, int, Words]]:
    """Texts ``[a, b)`` of a column with their words, some ``SLICE`` bytes at a time."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE, "right")) - 1)
        b = min(b, len(column))
        first, last = at[a:b] - at[a], at[a + 1 : b + 1] - at[a]
        full = (last > first) & ~null[a:b]
        own = np.flatnonzero(full)
        words = Words(data[at[a] : at[b]], first[own], last[own], kind)
        words.text = own[words.text] if len(own) else words.text
        words.first = first  # of every text, empty ones too
        yield a, b, words
        a = b
