"""Quality rules: compression bands.

zstandard compresses each whole text and each of its fixed chunks; the share of
bytes that remain is compared with limits that depend on the length. Text that
shrinks too well is repetitive, text that hardly shrinks is noise.

Defined results: a null or empty text has no words and fails the base rule. Rows
are judged one by one, so ties, repeated rows and an empty table need no rule.
`keep` returns the input's own columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from planecraft.llm.jobs import prepare
from planecraft.llm.text_arrays import SYMBOL, Slice, mix, ranks, shingles, slices

ASSESSED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, worst_chunk double, low_chunks double, high_chunks double"
)


@dataclass(frozen=True)
class Bands:
    """Limits on compressed / raw bytes.

    whole: (bytes from which the row holds, least ratio, largest ratio). Short texts
    carry the frame's header and have little to repeat, hence the wider bands.
    A chunk is out of its band outside [chunk_low, chunk_high]; a text is rejected
    if more than chunk_share of its chunks are. Chunks under half a chunk's size
    are not judged.
    """

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 1.5), (200, 0.32, 0.95), (1000, 0.36, 0.85), (5000, 0.32, 0.75), (50000, 0.28, 0.70))
    chunk_bytes: int = 4096
    chunk_low: float = 0.30
    chunk_high: float = 0.80
    chunk_share: float = 0.25
    level: int = 3
    min_words: int = 10
    repeat_percent: int = 20

    def band(self, n_bytes: int) -> tuple[float, float]:
        return next((low, high) for least, low, high in reversed(self.whole) if n_bytes >= least)


def distinct_lines(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that hold a word, and how many different ones."""
    breaks = np.flatnonzero(s.data == 0x0A)
    starts = np.sort(np.concatenate((s.bounds[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, s.bounds[1:])))
    # where starts tie, all but the last line are empty and so hold no word
    text = np.searchsorted(s.bounds, starts, "right") - 1
    has_word = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    line = ranks(s.data, starts, ends, s.hashes(starts, ends))
    _, at = np.unique(text * (len(line) + int(line.max(initial=0)) + 1) + line, return_index=True)
    return np.bincount(text, minlength=s.n), np.bincount(text[at], minlength=s.n)


def repeated_words(s: Slice, width: int = 5) -> np.ndarray:
    """Per text: words inside a window of `width` words that the text holds twice or more."""
    hashes, text, at = shingles(s.words(), s.first_word, width)
    key = mix(hashes + mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    twice = np.zeros(len(key) + 1, bool)
    twice[1:-1] = ordered[1:] == ordered[:-1]
    maybe = np.sort(order[twice[:-1] | twice[1:]])  # few windows: whether they are the same is seen from their words
    if not len(maybe):
        return np.zeros(s.n, np.int64)
    words = np.unique(at[maybe][:, None] + np.arange(width))
    number = np.zeros(len(s.starts), np.int64)
    number[words] = ranks(s.data, s.starts[words], s.ends[words], s.hashes(s.starts[words], s.ends[words]))
    rows = np.column_stack((text[maybe], number[at[maybe][:, None] + np.arange(width)]))
    order = np.lexsort(rows.T[::-1])
    new = np.concatenate(([True], (rows[order][1:] != rows[order][:-1]).any(1)))
    group = np.cumsum(new) - 1
    places = at[maybe[order[np.bincount(group)[group] > 1]]]
    edge = np.zeros(len(s.starts) + width + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + width, -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(edge)[: len(s.starts)] > 0)))
    return total[s.first_word[1:]] - total[s.first_word[:-1]]


def base_counts(s: Slice) -> dict[str, np.ndarray]:
    """The word, symbol, line and repetition counts of a slice's texts."""
    inside = np.zeros(len(s.data) + 1, np.int8)
    inside[s.starts] += 1
    inside[s.ends] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    lines, different = distinct_lines(s)
    return {
        "n_words": s.n_words(),
        "word_chars": s.per_text(in_word & ((s.data & 0xC0) != 0x80)),
        "n_symbols": s.per_text(SYMBOL[s.data]),
        "n_dup_lines": lines - different,
        "n_repeat_words": repeated_words(s),
    }


def compressed_shares(s: Slice, bands: Bands) -> tuple[np.ndarray, ...]:
    """Per text: ratio of the whole, the chunk ratio farthest from the band's middle, and the shares of chunks below and above the band."""
    packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
    ratio, worst, low, high = (np.zeros(s.n) for _ in range(4))
    raw, middle = memoryview(s.data.tobytes()), (bands.chunk_low + bands.chunk_high) / 2
    for i in range(s.n):
        a, b = int(s.bounds[i]), int(s.bounds[i + 1])
        ratio[i] = worst[i] = len(packer.compress(raw[a:b])) / (b - a) if b > a else 1.0
        chunks = range(a, b, bands.chunk_bytes)
        if len(chunks) > 1:
            found = [len(packer.compress(raw[c:e])) / (e - c) for c in chunks if (e := min(b, c + bands.chunk_bytes)) - c >= bands.chunk_bytes // 2]
            worst[i] = max(found, key=lambda x: abs(x - middle))
            low[i] = sum(x < bands.chunk_low for x in found) / len(found)
            high[i] = sum(x > bands.chunk_high for x in found) / len(found)
    return ratio, worst, low, high


def judge(column: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    """All counts and verdicts of a column of texts."""
    parts: list[dict[str, np.ndarray]] = []
    for _, _, s in slices(column, plain=True):  # what is counted is compared by bytes
        x = base_counts(s)
        x["ratio"], x["worst_chunk"], x["low_chunks"], x["high_chunks"] = compressed_shares(s, bands)
        sizes = np.diff(s.bounds)
        limits = np.array([bands.band(int(n)) for n in sizes])
        x["base_failed"] = (x["n_words"] < bands.min_words) | (100 * x["n_repeat_words"] > bands.repeat_percent * x["n_words"])
        inside = (x["ratio"] >= limits[:, 0]) & (x["ratio"] <= limits[:, 1])
        x["kept"] = ~x["base_failed"] & inside & (x["low_chunks"] + x["high_chunks"] <= bands.chunk_share)
        parts.append(x)
    names = [f.strip().split(" ")[0] for f in ASSESSED.split(",")][1:]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def assess(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Counts, ratios and the verdict of every text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = judge(batch.column("text"), bands)
                kinds = {"kept": pa.bool_(), "base_failed": pa.bool_()} | dict.fromkeys(("ratio", "worst_chunk", "low_chunks", "high_chunks"), pa.float64())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64())} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in x.items()})

    return docs.select("doc_id", "text").mapInArrow(run, ASSESSED)


def keep(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules accept, with all their columns."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch.column("text"), bands)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
