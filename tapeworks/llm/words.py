"""Word splitting and hashing over whole Arrow batches, in numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Words, and sequences of words, are named by 64-bit
hashes that depend on nothing but their bytes, so that every task gives equal text equal names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 19
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse mod 2**64, as many as were asked for yet."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base & M64, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up, self.down


_BYTES, _WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)


class Sums:
    """Hashes of any ranges of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(x + mix((end - start).astype(np.uint64)))


class Words:
    """The words of some texts: byte ranges in ``data``, hashes, and the first word of each text (``first``, one more at the end)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        self.offsets, self.data = offsets - lo, LOWER[raw] if lower else raw
        ink = ~SPACE[self.data]
        begins, ends = ink.copy(), ink.copy()
        begins[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(ink))]
        begins[cuts] = ink[cuts]
        ends[cuts - 1] = ink[cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = Sums(self.data.astype(np.uint64) + np.uint64(1), _BYTES).of(self.start, self.end)

    def sums(self) -> Sums:
        return Sums(self.hash, _WORDS)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about STEP_BYTES of text, so that memory doesn't grow with a batch's texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(column.cast(pa.large_string()).fill_null("").value_lengths() if hasattr(column, "value_lengths") else _lengths(column))
        total, begin = 0, 0
        for k, n in enumerate(sizes):
            if total and total + n > STEP_BYTES:
                yield batch.slice(begin, k - begin)
                total, begin = 0, k
            total += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
