"""Hashes of all words of a batch of texts at once, on the texts' bytes.

The hash of a run of bytes is a polynomial with a random value for each byte, modulo 2^64; from running sums over a chunk of texts the hash of any word
or word beginning follows by one subtraction and one product. It is mixed before use. Texts are taken in chunks that bound the memory; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 1 << 60)) * 8 + 5
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between ASCII white space; words of letters and digits, where bytes of other scripts count as letters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a chunk of texts: `start` and `end` byte positions, `first` word of each text (one more at the end)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray):
        self.data, self.bounds = data, bounds
        inside = is_word[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cut = bounds[:-1][bounds[:-1] < len(data)]
        before[cut] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = bounds[1:] - 1
        after[last[(last >= 0) & (bounds[1:] > bounds[:-1])]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self._sums: np.ndarray | None = None

    def hashes(self, which: np.ndarray | slice = slice(None), length: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first `length` bytes."""
        if self._sums is None:
            with np.errstate(over="ignore"):
                value = BYTE_VALUE[LOWER[self.data]]
                value *= powers(BASE, len(self.data))[: len(self.data)]
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        start, end = self.start[which], self.end[which]
        if length is not None:
            end = np.minimum(end, start + length)
        with np.errstate(over="ignore"):
            return mixed((self._sums[end] - self._sums[start]) * powers(INVERSE, len(self.data) + 1)[start] + (end - start).astype(np.uint64))


def chunks(texts: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) for consecutive texts of a column; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, side="right")) - 1)
        upto = min(upto, len(texts))
        yield at, Words(data[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at], is_word)
        at = upto
