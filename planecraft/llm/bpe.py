"""BPE by backtracking: Aho-Corasick matches checked against a pair-compatibility table.

At each place the longest token that matches is tried. It stands if it is compatible
with the token before it, that is if merging the two tokens' bytes gives these two
tokens again; else the next shorter token that is its prefix is tried, and where none
is left the last token is taken back. Places that lead nowhere are marked, so every
place is tried a bounded number of times and the merges are exact in linear time.
Decoding gathers each id's bytes from one table by offsets.

Defined results: a null text is empty and has no tokens. Rows are handled one by one,
so ties, repeated rows and an empty table need no rule; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from planecraft.llm.encoding import Encoder, byte_characters, one_word
from planecraft.llm.jobs import prepare

ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Backtracking:
    """Encoder and decoder of a byte-level BPE file whose ids follow the order of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cutter = Tokenizer.from_file(path)
        self.to_byte = {c: b for b, c in byte_characters().items()}
        vocabulary = spec["model"]["vocab"]
        self.tokens: list[bytes] = [b""] * (max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for text, i in vocabulary.items():
            self.tokens[i] = bytes(self.to_byte[c] for c in text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # rank of a token: single bytes come first, then tokens in the order of their merges
        self.rank = [0] * len(self.tokens)
        self.halves = [(i, i) for i in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(spec["model"]["merges"]):
            one, two, both = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merged[one, two], self.halves[both], self.rank[both] = both, (one, two), 256 + n
        for b in (i for i, t in enumerate(self.tokens) if len(t) == 1):
            self.rank[b] = self.tokens[b][0]
        self.automaton = ahocorasick.Automaton()
        own = {t: i for i, t in enumerate(self.tokens) if t}
        for t, i in own.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        # longest token that is a proper prefix of a token; -1: none
        self.shorter = [next((own[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in own), -1) if t else -1 for t in self.tokens]
        self.compatible: dict[tuple[int, int], bool] = {}
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens]))).astype(np.int64)

    def fits(self, one: int, two: int) -> bool:
        """Whether `one` and `two` stay apart when their bytes are merged together: no earlier merge joins them across the border."""
        known = self.compatible.get((one, two))
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[one, two] = self._fits(one, two)
        return known

    def _fits(self, one: int, two: int) -> bool:
        rank, halves, limit = self.rank, self.halves, float("inf")
        while True:
            joined = self.merged.get((one, two))
            if joined is not None and rank[joined] < limit:
                return False
            # undo the later merge of the two; what it was made of met the border before
            for side in (0, 1) if rank[one] > rank[two] else (1, 0):
                token = one if side == 0 else two
                part = halves[token][1 - side]
                if part != token:
                    limit = rank[token] + side
                    one, two = (part, two) if side == 0 else (one, part)
                    break
            else:
                return True

    def piece(self, raw: bytes) -> list[int]:
        n = len(raw)
        longest = [(0, -1)] * n
        for end, found in self.automaton.iter(raw.decode("latin-1")):
            start = end - found[0] + 1
            if found[0] > longest[start][0]:
                longest[start] = found
        out: list[int] = []
        open_place, at, token, tokens = [True] * (n + 1), 0, longest[0][1], self.tokens
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if open_place[end] and (last < 0 or self.fits(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at][1] if at < n else -1
            else:
                open_place[at] = False
                token = out.pop()
                at -= len(tokens[token])
        return out

    def units(self, units: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.piece(u) if one_word(u) else self.cut(u.decode()), np.uint32) for u in units]

    def cut(self, text: str) -> list[int]:
        """Ids of a text without special tokens: the pre-tokenizer's pieces, one by one."""
        return [i for piece, _ in self.cutter.pre_tokenizer.pre_tokenize_str(text) for i in self.piece(bytes(self.to_byte[c] for c in piece))]

    def whole(self, text: str) -> np.ndarray:
        out: list[int] = []
        while text:
            at, token = min(((p, t) for t in self.special if (p := text.find(t)) >= 0), default=(len(text), ""), key=lambda x: (x[0], -len(x[1])))
            out += self.cut(text[:at])
            if token:
                out.append(self.special[token])
            text = text[at + len(token) :]
        return np.array(out, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        before = np.cumsum(size) - size
        raw = self.blob[np.repeat(start - before, size) + np.arange(int(size.sum()))].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def backtracking(path: str) -> tuple[Backtracking, Encoder]:
    """One per Python worker and file."""
    own = Backtracking(path)
    return own, Encoder(own.units, own.whole)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Every text encoded and decoded again: its number of tokens, and digests of the ids and of the decoded text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encode = backtracking(path)
        decimal = list(map(str, range(len(own.tokens))))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = encode(batch.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, ROUND_TRIP)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = [x.astype(np.int32) for x in backtracking(path)[1](batch.column("text"))]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = backtracking(path)
        for batch in batches:
            if batch.num_rows:
                texts = [own.decode(np.array(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "text": texts})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
