"""Vectorised word and shingle hashing over Arrow string batches.

A batch's texts lie end to end in one byte buffer. Prefix sums of
``value(byte) * base**position`` modulo the prime 2**31 - 1, for two bases, give a
62-bit polynomial hash of any byte range in two array reads for each base, so words,
lines and whole texts are hashed without a Python loop. (Modulo a power of two such
hashes collide on regular texts whatever the base; modulo a prime two different
ranges of n bytes collide for at most n of the bases.) Where equal hashes are checked
byte by byte anyway, with `same_bytes`, a slice may be made `plain`: one base modulo
2**64, in half the time. A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; these are single bytes in UTF-8, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about so many bytes, which bounds the arrays of a step.
SLICE_BYTES = 1 << 20
LONG = 1 << 16
PRIME = (1 << 31) - 1
BASES = (1_205_847_963, 743_018_521)
PLAIN_BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, PRIME, 256, dtype=np.int64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


def reduced(x: np.ndarray) -> np.ndarray:
    """Nonnegative numbers below 2**63 as numbers below 2**32 + 2 that are equal modulo the prime."""
    return (x & PRIME) + (x >> 31)


def least(x: np.ndarray) -> np.ndarray:
    """The remainders of nonnegative numbers below 2**63."""
    x = reduced(reduced(x))
    return x - PRIME * (x >= PRIME)


def powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i for i below n, for each base; kept for the next slice."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        made = []
        for step in (x for base in BASES for x in (base, pow(base, -1, PRIME))):
            table, known = np.ones(size, np.uint32), 1
            while known < size:
                more = min(known, size - known)
                table[known : known + more] = table[:more].astype(np.int64) * pow(step, known, PRIME) % PRIME
                known += more
            made.append(table)
        _powers[:] = made
    return _powers


_plain_powers: list[np.ndarray] = []


def plain_powers(n: int) -> list[np.ndarray]:
    """The same modulo 2**64, of the plain base."""
    if not _plain_powers or len(_plain_powers[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        made = [np.full(size, step, np.uint64) for step in (PLAIN_BASE, pow(PLAIN_BASE, -1, 1 << 64))]
        for table in made:
            table[0] = 1
            np.multiply.accumulate(table, out=table)
        _plain_powers[:] = made
    return _plain_powers


@dataclass
class Slice:
    """Some consecutive texts of a batch. Word arrays run over all its texts; `first_word[d]` is where text d's words begin."""

    data: np.ndarray  # uint8, all texts end to end
    bounds: np.ndarray  # byte offset of each text, and the end
    prefix: tuple[np.ndarray, ...]  # for each base, prefix[i] = hash sum of bytes before i; one base in a plain slice
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    first_word: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the byte ranges [a, b): equal bytes give equal hashes wherever they stand."""
        if not len(a):
            return np.zeros(0, np.uint64)
        if len(self.prefix) == 1:
            prefix, inverse = self.prefix[0], plain_powers(len(self.data) + 1)[1]
            return mix((prefix[b] - prefix[a]) * inverse[a] + mix((b - a).astype(np.uint64)))
        key, tables = np.zeros(len(a), np.int64), powers(len(self.data) + 1)
        for prefix, inverse in zip(self.prefix, tables[1::2]):
            x = least(prefix[b] - prefix[a])
            key = (key << 31) | least(x * inverse[a].astype(np.int64))
        return mix(key.view(np.uint64) + mix((b - a).astype(np.uint64)))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-wise array over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def same_bytes(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of `one` from a[i] and those of `two` from b[i] are the same, sizes[i] of them."""
    same = np.ones(len(a), bool)
    long = np.flatnonzero(sizes > LONG)
    for i in long.tolist():
        same[i] = np.array_equal(one[a[i] : a[i] + sizes[i]], two[b[i] : b[i] + sizes[i]])
    short = np.flatnonzero(sizes <= LONG)
    ends = np.cumsum(sizes[short])
    at = 0
    while at < len(short):  # some bytes at a time
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        part = short[at:upto]
        owner = np.repeat(part, sizes[part])
        step = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
        same[owner[one[a[owner] + step] != two[b[owner] + step]]] = False
        at = upto
    return same


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the byte ranges: two have the same number if and only if their bytes are the same."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[number]
    odd = ends - starts != ends[like] - starts[like]
    even = np.flatnonzero(~odd & (like != np.arange(len(like))))
    odd[even] = ~same_bytes(data, starts[even], data, starts[like[even]], (ends - starts)[even])
    if odd.any():  # two different ranges with one hash
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(odd).tolist():
            number[i] = len(first) + known.setdefault(data[starts[i] : ends[i]].tobytes(), len(known))
    return number


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts end to end, and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts whose bytes come to about `size`; a longer text is a run of its own."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def make_slice(data: np.ndarray, bounds: np.ndarray, plain: bool = False) -> Slice:
    values, prefix = BYTE_VALUE[data], []
    if plain:
        prefix.append(np.zeros(len(data) + 1, np.uint64))
        np.cumsum(values.view(np.uint64) * plain_powers(len(data) + 1)[0][: len(data)], out=prefix[0][1:])
    else:
        for base in powers(len(data) + 1)[::2]:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(reduced(values * base[: len(data)]), out=sums[1:])
            prefix.append(sums)
    space = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    before = np.concatenate(([True], space[:-1])) if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero(~space & (before | first[:-1]))
    last = np.zeros(len(data) + 1, bool)
    last[bounds[1:]] = True
    after = np.concatenate((space[1:], [True])) if len(data) else np.zeros(0, bool)
    ends = np.flatnonzero(~space & (after | last[1:])) + 1
    return Slice(data, bounds, tuple(prefix), starts, ends, np.searchsorted(starts, bounds))


def slices(column: pa.Array, size: int = SLICE_BYTES, plain: bool = False) -> Iterator[tuple[int, int, Slice]]:
    """(a, b, slice) for the texts a to b of a string column."""
    data, bounds = text_bytes(column)
    for a, b in spans(bounds, size):
        yield a, b, make_slice(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], plain)


WINDOW_FACTORS = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, first_word: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside one text, the text of each, and its first word's place."""
    n = len(words) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    h = words[:n] * WINDOW_FACTORS[0]
    for j in range(1, width):
        h = h + words[j : n + j] * WINDOW_FACTORS[j]
    text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    inside = np.flatnonzero(text[:n] == text[width - 1 :])
    return mix(h[inside]), text[inside], inside
