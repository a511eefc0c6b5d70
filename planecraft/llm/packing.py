"""Packing along a space-filling curve.

Each document's words are hashed into a signed vector, the vector is projected to
three dimensions, and its place on a Hilbert curve through their cube is its key.
A range partitioning by (key, doc_id) deals neighbours along the curve into the
same partition; inside it, documents are laid end to end in key order and cut every
`length` tokens, so only a partition's last sequence holds padding. The key needs
no token ids: texts are shuffled once, and each is encoded once, after the shuffle.

Defined results: a null text is empty and has its end token only, with the curve's
middle as key; a null doc_id sorts first; repeated rows are packed each. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.llm.encoding import encoder
from planecraft.llm.jobs import partitions, prepare
from planecraft.llm.text_arrays import mix, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
DIMS, PROJECTED, LEVEL_BITS = 256, 3, 10


@dataclass(frozen=True)
class Packing:
    """The tokenizer's file and pre-tokenizer, the id that ends a document, and the sequences' length."""

    path: str
    kind: str = "word"
    end_id: int = 1
    length: int = 2048


def projection() -> np.ndarray:
    x = mix(np.arange(DIMS * PROJECTED, dtype=np.uint64) + np.uint64(77)).reshape(DIMS, PROJECTED)
    return np.where(x & np.uint64(1), 1.0, -1.0) * np.sqrt(1 / PROJECTED)


def hilbert(levels: np.ndarray, bits: int = LEVEL_BITS) -> np.ndarray:
    """Distances along the Hilbert curve of points (n, dims) with coordinates below 2**bits (Skilling's transform)."""
    x = levels.astype(np.int64).T.copy()
    n = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(n):
            on = (x[i] & step) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn = np.where(x[n - 1] & step, turn ^ (step - 1), turn)
        step >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(column: pa.Array) -> np.ndarray:
    """The Hilbert key of every text."""
    keys, to_few = [], projection()
    for _, _, s in slices(column, plain=True):
        words = s.words()
        place = (words >> np.uint64(8)) & np.uint64(DIMS - 1)
        sign = np.where(words & np.uint64(1), 1.0, -1.0)
        text = np.repeat(np.arange(s.n), s.n_words())
        vectors = np.bincount(text * DIMS + place.astype(np.int64), sign, s.n * DIMS).reshape(s.n, DIMS)
        norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        few = vectors @ to_few / np.maximum(norm, 1e-9)
        levels = np.clip((np.tanh(few) + 1) / 2 * (1 << LEVEL_BITS), 0, (1 << LEVEL_BITS) - 1)
        keys.append(hilbert(levels.astype(np.int64)))
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def along_curve(docs: DataFrame) -> DataFrame:
    """(doc_id, text, curve_key), range-partitioned and sorted along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text"), pa.array(curve_keys(batch.column("text")))], ["doc_id", "text", "curve_key"])

    keyed = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, curve_key long")
    return keyed.repartitionByRange(partitions(docs, each=8 << 20), "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", F.xxhash64("text"), "text")


def pack(docs: DataFrame, how: Packing) -> DataFrame:
    """The pieces of all documents. A sequence's id is its partition's number and its place in it, so no count of other partitions is needed."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(how.path, how.kind), np.array([how.end_id], "<u4").tobytes()
        sequence, at = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            rows = []
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                ids = memoryview(encoded.astype("<u4").tobytes() + end)
                total, start = len(ids) // 4, 0
                while start < total:
                    length = min(how.length - at, total - start)
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, sequence, at))
                    start, at = start + length, at + length
                    if at == how.length:
                        sequence, at = sequence + 1, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], [x.split()[0] for x in PIECES.split(", ")])

    return along_curve(docs).select("doc_id", "text").mapInArrow(run, PIECES)
