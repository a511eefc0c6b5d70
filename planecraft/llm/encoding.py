"""Whole texts to token ids, each different piece of text encoded once.

BPE never merges across the pieces that the pre-tokenizer cuts, so a text's ids are
its pieces' ids in a row. Texts are cut into units at places that are piece
boundaries for both public pre-tokenizers: before a run of white space, and where a
letter is followed by a digit or a sign. Units are hashed and looked up in arrays,
all of a slice at once; only units that are not in the table are encoded, so the
cost follows the number of different words. Texts with characters outside a plain
range, where this cutting isn't proven, and texts that may spell a special token,
are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from planecraft.llm.text_arrays import SPACE, make_slice, same_bytes, spans, text_bytes  # noqa: E402

#: Slots of the table of units; it starts anew when three in five are taken.
SLOT_BITS = 21

PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x20, 0x7F), *range(0x09, 0x0E), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]] = True  # ASCII, U+00C0 to U+017F
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC6)]] = True  # of plain texts
SIGN = np.zeros(256, bool)
SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalpha() and b != 0x27]] = True  # an apostrophe may begin a contraction
one_word = re.compile(rb" ?[A-Za-z\x80-\xff]+").fullmatch

#: The printable characters that stand for bytes in byte-level vocabularies: fixed by that format.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    others = [b for b in range(256) if b not in PRINTABLE]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


class Library:
    """A tokenizer file and the library's encoding of it, without truncation, padding or added tokens. kind: 'byte' or 'word'."""

    def __init__(self, path: str, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.word = kind == "word"
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the table of units is the cache
        self.characters = byte_characters()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def units(self, units: list[bytes]) -> list[np.ndarray]:
        """A unit that is one word is one piece, which the model takes directly."""
        return [self.one(u) if one_word(u) else self.whole(u.decode()) for u in units]

    def one(self, unit: bytes) -> np.ndarray:
        if self.word:
            unit = unit.strip().decode().lower().encode()
        return np.array([t.id for t in self.model.tokenize(unit.decode("latin-1").translate(self.characters))], np.uint32)


class UnitTable:
    """Ids by a unit's 64-bit hash: open addressing over arrays, with all units of a slice probed together.

    The units' bytes are kept, and compared at each use: a unit that shares the hash of another is encoded by itself.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], slot_bits: int = SLOT_BITS):
        self.encode, self.size = encode, 1 << slot_bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.n_ids, self.n = np.zeros(4096, np.uint32), 0, 0
        self.at, self.size_of = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.bytes, self.n_bytes = np.zeros(4096, np.uint8), 0

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its slot, or the free slot where it belongs, and whether it is there."""
        slots = (hashes >> np.uint64(7)).astype(np.int64) & (self.size - 1)
        held = self.keys[slots]
        there = held == hashes
        left = np.flatnonzero(~there & (held != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (self.size - 1)
            held = self.keys[slots[left]]
            there[left] = held == hashes[left]
            left = left[(held != hashes[left]) & (held != 0)]
        return slots, there

    def add(self, hashes: np.ndarray, units: list[bytes]) -> None:
        encoded = self.encode(units)
        counts, sizes = np.array([len(x) for x in encoded], np.int64), np.array([len(x) for x in units], np.int64)
        total, n, held = self.n_ids + int(counts.sum()), self.n + len(encoded), self.n_bytes + int(sizes.sum())
        while total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while held > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros_like(self.bytes)))
        while n > len(self.start):
            self.start, self.count, self.at, self.size_of = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.count, self.at, self.size_of))
        self.bytes[self.n_bytes : held] = np.frombuffer(b"".join(units), np.uint8)
        self.at[self.n : n] = self.n_bytes + np.cumsum(sizes) - sizes
        self.size_of[self.n : n] = sizes
        self.n_bytes = held
        self.ids[self.n_ids : total] = np.concatenate(encoded)
        self.start[self.n : n] = self.n_ids + np.cumsum(counts) - counts
        self.count[self.n : n] = counts
        entries = np.arange(self.n, n, dtype=np.int32)
        self.n_ids, self.n = total, n
        while len(hashes):  # where several want a slot, one gets it and the others probe again
            slots, _ = self.probe(hashes)
            self.keys[slots] = hashes
            won = self.keys[slots] == hashes
            self.entry[slots[won]] = entries[won]
            hashes, entries = hashes[~won], entries[~won]

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids in a row, and the number of ids of each. More units than half the slots, as very long texts have, are looked up in portions."""
        most = self.size // 2
        if len(hashes) > most:
            portions = [self.look_up(data, starts[i : i + most], ends[i : i + most], hashes[i : i + most]) for i in range(0, len(hashes), most)]
            return np.concatenate([ids for ids, _ in portions]), np.concatenate([counts for _, counts in portions])
        hashes = hashes | np.uint64(1)  # 0 marks a free slot
        slots, there = self.probe(hashes)
        if not there.all():
            gone = np.flatnonzero(~there)
            new, first = np.unique(hashes[gone], return_index=True)
            if self.n + len(new) > 0.6 * self.size or self.n_bytes > 1 << 26:
                self.clear()
                new, first = np.unique(hashes, return_index=True)
                gone = np.arange(len(hashes))
            raw = data.tobytes()
            self.add(new, [raw[a:b] for a, b in zip(starts[gone[first]].tolist(), ends[gone[first]].tolist())])
            slots, _ = self.probe(hashes)
        entry, sizes = self.entry[slots], ends - starts
        counts = self.count[entry]
        before = np.cumsum(counts) - counts
        ids = self.ids[np.repeat(self.start[entry] - before, counts) + np.arange(int(counts.sum()))]
        other = self.size_of[entry] != sizes
        alike = np.flatnonzero(~other)
        other[alike] = ~same_bytes(data, starts[alike], self.bytes, self.at[entry[alike]], sizes[alike])
        if not other.any():
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(other).tolist():
            parts[i] = self.encode([data[starts[i] : ends[i]].tobytes()])[0]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


class Encoder:
    """The ids of every text of a column. `units` encodes units that are new, `whole` the texts that are not cut."""

    def __init__(self, units: Callable[[list[bytes]], list[np.ndarray]], whole: Callable[[str], np.ndarray]):
        self.table, self.whole = UnitTable(units), whole

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        data, bounds = text_bytes(column)
        found: list[np.ndarray] = []
        for a, b in spans(bounds):
            found += self.slice(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        return found

    def slice(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        if not len(data):
            return [np.zeros(0, np.uint32)] * (len(bounds) - 1)
        s, n = make_slice(data, bounds, plain=True), len(data)
        space, letter = SPACE[data], LETTER[data]
        cut = np.zeros(n + 1, bool)
        cut[bounds[:-1]] = True
        cut[1:n] |= (space[1:] & ~space[:-1]) | (letter[:-1] & SIGN[data[1:]])
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        odd = ~PLAIN[data]
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # "<|" opens the special tokens
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs among U+00C0 to U+017F
        strange = np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1)
        text = np.searchsorted(bounds, starts, "right") - 1
        if len(strange):
            plain = ~np.isin(text, strange)
            starts, ends, text = starts[plain], ends[plain], text[plain]
        ids, counts = self.table.look_up(data, starts, ends, s.hashes(starts, ends))
        edges = np.concatenate(([0], np.cumsum(np.bincount(text, counts, len(bounds) - 1).astype(np.int64))))
        found = [ids[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for i in strange.tolist():
            found[i] = self.whole(data[bounds[i] : bounds[i + 1]].tobytes().decode())
        return found


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One per Python worker and file."""
    library = Library(path, kind)
    return Encoder(library.units, library.whole)
