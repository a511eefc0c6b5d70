"""Target-distribution importance resampling with a dictionary of distinct features.

Features are the runs of one to three words of a text. A task puts texts together into slices and
finds the distinct features of each slice with their counts. These are dealt by the features' hash
to the parts of one dictionary of the whole corpus: a part counts each of its strings, hashes each
distinct string once into a bucket, and adds up the buckets. From the sums of all parts, and those
of the target's texts, each bucket gets a gain. The dictionary's buckets then go back, by slice, to
the per-document features, where gains are added up, and the documents of the highest score are drawn.

A part gets a feature once from each slice, however often texts repeat it. Features are dealt by the
hash of their whole string, but three words go with their first two, whose bytes are then sent once,
unless a slice has many such triples of one pair; so no word or phrase makes one part large. (A triple
that is dealt in both ways has an entry in two parts, whose counts add up to the same bucket.) Strings
are compared whole. Slices are made twice from the same rows, once for the dictionary and once for the weights;
each is named by its place and a digest of its content, and one without its buckets stops the job
(that happens only if `documents` gives other rows when it is read again).

Defined results: a null text has no features, and weight 0. A null doc_id is hashed as the empty
string and comes last among equal scores. Rows that repeat a doc_id are documents of their own; ties
that doc_id leaves are broken by weight and n_features. Without a target text all counts of the
target are 0. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planecraft.llm.jobs import partitions, prepare, stored
from planecraft.llm.text_arrays import mix, spans, text_bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPACE, NOTHING, BREAK = (pa.scalar(b, pa.large_binary()) for b in (b" ", b"", b"\n"))
#: Triples of a pair with more followers in a slice are dealt by their own hash, so that no pair makes a part large.
FOLLOWERS = 16
_FACTORS = mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Resampling:
    """Buckets, seed, least words of a document that may be drawn, share drawn (in hundredths), bytes of a slice and of texts a part."""

    buckets: int = 10_000
    seed: str = "42"
    least_words: int = 20
    percent: int = 5
    slice_bytes: int = 6 << 20
    part_bytes: int = 8 << 20
    level: int = 3


class Features:
    """The features of some texts: distinct ones with counts, in order of part and string, and where in the texts each stands."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, parts: int):
        low = LOWER[data]
        inside = WORD[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[bounds] = True
        first = inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]) if len(low) else inside
        starts = np.flatnonzero(first)
        text = (np.searchsorted(bounds, starts, "right") - 1).astype(np.int32)
        self.n_words = np.bincount(text, minlength=len(bounds) - 1)
        self.first_word = np.concatenate(([0], np.cumsum(self.n_words)))
        last = inside & (np.concatenate((~inside[1:], [True])) | edge[1:]) if len(low) else inside
        offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - starts))).astype(np.int32)
        encoded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        del low, inside, edge, first, last, offsets, starts
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        self.words = encoded.dictionary.take(pa.array(order)).cast(pa.large_binary())
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.one = rank[encoded.indices.to_numpy()]
        del encoded, rank
        n, size = len(self.one), max(len(order), 1)
        self.at_two = np.flatnonzero(text[: max(n - 1, 0)] == text[1:])
        self.at_three = np.flatnonzero(text[: max(n - 2, 0)] == text[2:])
        del text
        two, self.two, count_two = np.unique(self.one[self.at_two] * size + self.one[self.at_two + 1], return_inverse=True, return_counts=True)
        place = np.zeros(n, np.int64)
        place[self.at_two] = self.two
        three, self.three, count_three = np.unique(place[self.at_three] * size + self.one[self.at_three + 2], return_inverse=True, return_counts=True)
        self.two, self.three = self.two.astype(np.int32), self.three.astype(np.int32)
        del place
        lead = three // size
        pair, last = (two // size, two % size), three % size
        self.counts = [np.bincount(self.one, minlength=len(order)), count_two, count_three]
        raw = self.words.to_pylist()
        hashed = mix(np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw)) | (np.fromiter(map(len, raw), np.uint64, len(raw)) << np.uint64(32)))
        whole = lambda *words: ((mix(sum(hashed[w] * f for f, w in zip(_FACTORS, words))) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        part_two = whole(*pair)
        crowded = np.flatnonzero(np.bincount(lead, minlength=len(two))[lead] > FOLLOWERS)
        few = np.flatnonzero(np.bincount(lead, minlength=len(two))[lead] <= FOLLOWERS)
        self.pair, self.triple, self.lead, self.size = pair, (pair[0][lead], pair[1][lead], last), lead, len(order)
        # the groups of a piece: kind, features in order of part and string, and where each part's begin
        self.groups = []
        for kind, chosen, part in (
            (0, np.arange(len(order)), whole(np.arange(len(order)))),
            (2, crowded, whole(*(w[crowded] for w in self.triple))),
            (1, np.arange(len(two)), part_two),
            (2, few, part_two[lead[few]]),
        ):
            sorting = np.argsort(part, kind="stable")
            self.groups.append((kind, chosen[sorting], np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))))

    def pieces(self) -> Iterator[tuple[int, list[bytes]]]:
        """Of each part with features: the lines of single words and crowded triples, those of pairs, those of other triples' last words, how many follow each pair, and all counts in this order."""
        ended = pc.binary_join_element_wise(self.words, NOTHING, BREAK)
        spaced = pc.binary_join_element_wise(NOTHING, ended, SPACE)
        (_, one, _), (_, crowded, _), (_, two, _), (_, few, _) = self.groups
        joined = lambda *columns: pc.binary_join_element_wise(*columns, NOTHING)
        take = lambda words, i: words.take(pa.array(i))
        first, second, third = (w[crowded] for w in self.triple)
        made = [
            take(ended, one),
            joined(take(self.words, first), take(pc.binary_join_element_wise(NOTHING, self.words, SPACE), second), take(spaced, third)),
            joined(take(self.words, self.pair[0][two]), take(spaced, self.pair[1][two])),
            take(spaced, self.triple[2][few]),
        ]
        raw = [(memoryview(m.buffers()[2] or b""), np.frombuffer(m.buffers()[1], np.int64)[m.offset : m.offset + len(m) + 1]) for m in made]
        following = np.zeros(len(self.pair[0]), np.uint32)
        np.add.at(following, self.lead[few], 1)
        for p in range(len(self.groups[0][2]) - 1):
            spans_of = [(e[p], e[p + 1]) for _, _, e in self.groups]
            if all(a == b for a, b in spans_of):
                continue
            text = [bytes(m[o[a] : o[b]]) for (m, o), (a, b) in zip(raw, spans_of)]
            counts = np.concatenate([self.counts[kind][order[a:b]] for (kind, order, _), (a, b) in zip(self.groups, spans_of)]).astype(np.uint32)
            a, b = spans_of[2]
            yield p, [text[0] + text[1], text[2], text[3], following[two[a:b]].tobytes(), counts.tobytes()]

    def sums(self, buckets: list[np.ndarray], gains: np.ndarray) -> np.ndarray:
        """The gains of each text's features, from the buckets of each part's features in their order."""
        each = [np.zeros(len(c), np.int64) for c in self.counts]
        for p, found in enumerate(buckets):
            at = 0
            for kind, order, edges in self.groups:
                mine = order[edges[p] : edges[p + 1]]
                each[kind][mine] = gains[found[at : at + len(mine)]]
                at += len(mine)
        total = each[0][self.one]
        total[self.at_two] += each[1][self.two]
        total[self.at_three] += each[2][self.three]
        before = np.concatenate(([0], np.cumsum(total)))
        return before[self.first_word[1:]] - before[self.first_word[:-1]]


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(name, ids, bytes, bounds): a task's texts put together to about `size` bytes; a longer text is a slice of its own."""
    task, nth = TaskContext.get().partitionId(), 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    held_bytes = 0

    def joined() -> tuple[str, pa.Array, np.ndarray, np.ndarray]:
        ids, data = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
        bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))))
        digest = hashlib.blake2b(data.tobytes() + bounds.tobytes() + repr(ids.to_pylist()).encode(), digest_size=12).hexdigest()
        return f"{task}-{nth}-{digest}", ids, data, bounds

    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        for a, b in spans(bounds, size):
            part = batch.column("doc_id").slice(a, b - a), data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            if held and held_bytes + len(part[1]) > size:
                yield joined()
                held, held_bytes, nth = [], 0, nth + 1
            held.append(part)
            held_bytes += len(part[1])
    if held:
        yield joined()


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def dictionary(texts: DataFrame, parts: int, how: Resampling) -> DataFrame:
    """(slice, part, buckets, sums): for each part the counts of its buckets, and for each slice's piece of it the buckets of the piece's features."""
    pieces = ["lines", "pairs", "lasts", "following", "counts"]
    fields = [("part", pa.int32()), ("slice", pa.string()), *((c, pa.binary()) for c in pieces)]
    out = [("slice", pa.string()), ("part", pa.int32()), ("buckets", pa.binary()), ("sums", pa.list_(pa.int64()))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=how.level).compress
        for name, _, data, bounds in _slices(batches, how.slice_bytes):
            rows = [(p, name, *map(pack, piece)) for p, piece in Features(data, bounds, parts).pieces()]
            if rows:
                yield _batch(rows, fields)

    def merge(table: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=how.level).compress
        names, part = table.column("slice").to_pylist(), table.column("part")[0].as_py()
        numbers = lambda c: [np.frombuffer(unpack(x), np.uint32) for x in table.column(c).to_pylist()]
        counts, following = numbers("counts"), numbers("following")

        def lines(column: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
            """The number of each line among the distinct ones, those, and how many lines each slice has."""
            raw = [np.frombuffer(unpack(x), np.uint8) for x in table.column(column).to_pylist()]
            sizes = np.array([np.count_nonzero(r == 10) for r in raw])
            raw = np.concatenate(raw)
            breaks = np.flatnonzero(raw == 10)
            offsets = np.concatenate(([0], breaks - np.arange(len(breaks)))).astype(np.int64)
            encoded = pa.Array.from_buffers(pa.large_binary(), len(breaks), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 10])]).dictionary_encode()
            return encoded.indices.to_numpy(), encoded.dictionary, sizes

        def hashed(strings: pa.Array, before: np.ndarray | None = None) -> np.ndarray:
            found = np.empty(len(strings), np.uint32)
            for a in range(0, len(strings), 1 << 16):
                some = strings.slice(a, 1 << 16).to_pylist()
                found[a : a + len(some)] = np.fromiter(map(zlib.crc32, some, *([] if before is None else [before[a : a + len(some)].tolist()])), np.uint32, len(some))
            return found

        # each distinct string is counted and hashed once; a triple's hash goes on from its pair's
        (at_line, line, n_line), (at_pair, pair, n_pair), (at_last, last, n_last) = (lines(c) for c in pieces[:3])
        hash_line, hash_pair = hashed(line), hashed(pair)
        # places are 4-byte numbers, whose products are not
        key, at_triple = np.unique(np.repeat(at_pair.astype(np.int64), np.concatenate(following)) * max(len(last), 1) + at_last, return_inverse=True)
        hash_triple = hashed(last.take(pa.array(key % max(len(last), 1))), hash_pair[key // max(len(last), 1)])
        found = [(h % np.uint32(how.buckets)).astype(np.uint16) for h in (hash_line, hash_pair, hash_triple)]
        ends = [np.cumsum(n) for n in (n_line, n_pair, n_last)]
        sums, packed = np.zeros(how.buckets), []
        for k, numbers_of in enumerate(counts):
            runs = [(e[k - 1] if k else 0, e[k]) for e in ends]
            mine = np.concatenate([f[at[a:b]] for f, at, (a, b) in zip(found, (at_line, at_pair, at_triple), runs)])
            sums += np.bincount(mine, numbers_of, how.buckets)
            packed.append(pack((mine >> 8).astype(np.uint8).tobytes() + mine.astype(np.uint8).tobytes()))  # high bytes are few, so they stand together
        return pa.Table.from_batches([_batch([*((s, part, b, None) for s, b in zip(names, packed)), (None, part, None, sums.astype(np.int64))], out)])

    dealt = texts.select("doc_id", "text").mapInArrow(cut, "part int, slice string, " + ", ".join(f"{c} binary" for c in pieces))
    return dealt.groupBy("part").applyInArrow(merge, "slice string, part int, buckets binary, sums array<long>")


def bucket_sums(entries: DataFrame, how: Resampling) -> np.ndarray:
    """Counts of all buckets, which are a fixed number."""
    rows = entries.where("sums is not null").select(F.posexplode("sums").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(how.buckets, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    size, s, t = float(len(source)), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weights(documents: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    if how.buckets > 1 << 16:
        raise ValueError("buckets are kept in two bytes")
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = partitions(docs, each=how.part_bytes)
    entries = stored(dictionary(docs, parts, how), "dictionary")
    wanted = dictionary(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string")), partitions(target, each=how.part_bytes), how)
    gain = gains(bucket_sums(entries, how), bucket_sums(wanted, how))
    fields = [("slice", pa.string()), ("part", pa.int32()), ("buckets", pa.binary()), ("ids", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int64())), ("texts", pa.binary())]
    out = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=how.level).compress
        for name, ids, data, bounds in _slices(batches, how.slice_bytes):
            low = LOWER[data]
            yield _batch([(name, None, None, ids.to_pylist(), bounds.tolist(), pack(np.where(WORD[low], low, 32).astype(np.uint8).tobytes()))], fields)

    def weighed(table: pa.Table) -> pa.Table:
        unpack, rows = zstandard.ZstdDecompressor().decompress, table.to_pylist()
        texts = [r for r in rows if r["texts"] is not None]
        if not texts:
            raise ValueError("documents gave other rows when they were read again")
        bounds = np.array(texts[0]["bounds"], np.int64)
        found = Features(np.frombuffer(unpack(texts[0]["texts"]), np.uint8), bounds, parts)
        buckets = [np.zeros(0, np.int64)] * parts
        for r in rows:
            if r["texts"] is None:
                raw = np.frombuffer(unpack(r["buckets"]), np.uint8).astype(np.int64).reshape(2, -1)
                buckets[r["part"]] = raw[0] << 8 | raw[1]
        if [len(b) for b in buckets] != np.sum([np.diff(e) for _, _, e in found.groups], 0).tolist():
            raise ValueError("documents gave other rows when they were read again")
        n = found.n_words
        features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
        del rows
        columns = texts[0]["ids"], n, features, found.sums(buckets, gain)
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, out)], [name for name, _ in out])

    kind = "slice string, part int, buckets binary, ids array<long>, bounds array<long>, texts binary"
    slices = docs.mapInArrow(kept, kind)
    back = entries.where("slice is not null").selectExpr("slice", "part", "buckets", "cast(null as array<long>) ids", "cast(null as array<long>) bounds", "cast(null as binary) texts")
    return slices.unionByName(back).groupBy("slice").applyInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def resample(documents: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank is null for documents that aren't drawn."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(how.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / 4294967296.0)))
    scored = stored(weights(documents, target, how).withColumn("score", F.col("weight") + gumbel), "scores")
    able = scored.where(F.col("n_words") >= how.least_words)
    draw = how.percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    # sorted by range; a row's rank is its place in its range and the rows of the ranges before it
    width = documents.sparkSession.sparkContext.defaultParallelism
    ranged = able.repartitionByRange(max(width, draw // 1_000_000), *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("place", F.monotonically_increasing_id()), "ranks").withColumn("range", F.shiftright("place", 33))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    ranked = placed.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1)
    drawn = F.when(F.col("rank") <= draw, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, drawn.alias("rank")).unionByName(scored.where(F.col("n_words") < how.least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
