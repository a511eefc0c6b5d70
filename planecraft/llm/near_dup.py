"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A text is its runs of five words, each weighted term frequency x inverse document
frequency. Document frequencies are counted over all documents in a table of fixed
size, addressed by the shingle's hash: a counter's background is the same share of
the corpus at every size, so what is told apart (shingles in more than about one
document in a thousand) does not depend on the scale. Every text gets `bands` x
`rows` consistent weighted samples; two texts share a sample with a probability
equal to their weighted Jaccard similarity. Texts that share all samples of a band
are candidates, and candidates are verified with the exact weighted Jaccard. A pair
whose plain Jaccard of shingle sets reaches the threshold is linked as well: weights
fall with a family's size, and a large family must not fall apart for that.
Verified links are joined into classes by distributed connected components.

Exact copies are one node before any bucket is formed. A bucket of up to
`all_pairs` nodes gives all its pairs. In a larger one every node is paired with
one node, drawn by the bucket's hash, so that pairs grow with the bucket and not
with its square. A large bucket that is one class after that needs no more. In the
others, the texts outside the bucket's largest class are held against all its texts
in blocks of bounded size, and only links between classes leave a block: no link of
two texts that share a band is lost. The work of that last step grows with (texts
outside the largest class) x (texts of the bucket), in parallel tasks.

Defined results: a text under five words is one shingle of all its words; a text
without words, or null, is compared only as a copy of an equal text, null never.
doc_id identifies a document: rows that repeat a doc_id are one document, whose
class is that of each of its texts. Candidates are pairs of texts, not of doc_ids: a
text is the least doc_id that holds it, and its digest. A row with a null doc_id gets
a null class and is kept. An empty table gives an empty result. `keep` returns one
row of each class, with the input's own columns whatever their names; of rows that
repeat the surviving doc_id it is the first in the order of the row as JSON.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planecraft.llm.jobs import prepare, small_or_shuffled, stored
from planecraft.llm.text_arrays import mix, shingles, slices

COUNTER_BITS = 20
BLOCK_BITS = 14
PAIR = ("a", "tag_a", "b", "tag_b")


@dataclass(frozen=True)
class Weighted:
    """Parameters: words in a shingle, samples, the similarity from which texts are linked, the bucket size up to which all pairs are made, and the size of a block of a larger bucket."""

    width: int = 5
    bands: int = 16
    rows: int = 4
    similarity: float = 0.8
    all_pairs: int = 24
    block_bytes: int = 4 << 20
    block_texts: int = 512


def text_shingles(s, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per slice: distinct (text, shingle) in order, with their counts. Texts under `width` words give one shingle of all their words."""
    words, n = s.words(), s.n_words()
    hashes, text, _ = shingles(words, s.first_word, width)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.array([mix(np.array([len(words[s.first_word[d] : s.first_word[d + 1]])], np.uint64) + np.sum(mix(words[s.first_word[d] : s.first_word[d + 1]] + np.arange(n[d], dtype=np.uint64))))[0] for d in short], np.uint64)
        hashes, text = np.concatenate((hashes, extra)), np.concatenate((text, short))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if not len(hashes):
        return text, hashes, np.zeros(0, np.int64)
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes)))


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, how: Weighted) -> tuple[np.ndarray, int]:
    """For each counter the number of documents with a shingle of it (a document counts once for each such shingle), and the number of documents.

    Every task sends its counters as compressed blocks; they are added in two steps, so that no task gets more than the square root of all.
    """
    size = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(1 << COUNTER_BITS, np.uint32), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, s in slices(batch.column("text")):
                table += np.bincount(counter_of(text_shingles(s, how.width)[1]), minlength=len(table)).astype(np.uint32)
        if n:
            packer, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() % 1024
            blocks = [packer.compress(x.astype(np.uint64).tobytes()) for x in table.reshape(-1, size)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1, *range(len(blocks))], pa.int32()), "part": pa.array([part] * (len(blocks) + 1), pa.int32()), "counts": [packer.compress(np.array([n], np.uint64).tobytes()), *blocks]})

    def add(pdf):
        opened = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(opened.decompress(x), np.uint64) for x in pdf["counts"])
        return pdf[["block", "part"]].head(1).assign(counts=[zstandard.ZstdCompressor(level=3).compress(total.tobytes())])

    schema = "block int, part int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).groupBy("block", "part").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    opened, table, n = zstandard.ZstdDecompressor(), np.zeros((1 << (COUNTER_BITS - BLOCK_BITS), size), np.uint64), 0
    for row in sums.collect():  # a table of fixed size
        counts = np.frombuffer(opened.decompress(bytes(row.counts)), np.uint64)
        if row.block < 0:
            n = int(counts[0])
        else:
            table[row.block] = counts
    return table.reshape(-1), n


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    """Between 1 (in every document) and 2: smoothed, so that a family of many copies keeps most of its weight beside the words in which they differ."""
    return (1 + np.log1p(n / np.maximum(counts, 1)) / np.log1p(max(n, 1))).astype(np.float32)


_samples: dict[str, np.ndarray] = {}


def quantiles() -> tuple[np.ndarray, np.ndarray]:
    """65,536 equally likely values of Gamma(2, 1), by Newton's method on its distribution function; and their logarithms."""
    if not _samples:
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.full(len(p), 1.7)
        for _ in range(60):
            x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - p) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
            x = np.minimum(x, 40)
        _samples["gamma"], _samples["log"] = x.astype(np.float32), np.log(x).astype(np.float32)
    return _samples["gamma"], _samples["log"]


def signature(hashes: np.ndarray, weights: np.ndarray, n_samples: int, columns: int = 1024) -> np.ndarray:
    """Improved consistent weighted samples of one weighted set, each as a 64-bit hash of (element, quantised weight).

    Element h with weight S draws r, c ~ Gamma(2,1) and b ~ U(0,1) from its own hash;
    t = floor(ln S / r + b); the element with the least ln c - r (t - b + 1) is taken.
    """
    gamma, log_gamma = quantiles()
    seeds = mix(np.arange(1, n_samples + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[:, None]
    best, taken = np.full(n_samples, np.inf, np.float32), np.zeros(n_samples, np.uint64)
    rows = np.arange(n_samples)
    for a in range(0, len(hashes), columns):
        h, log_s = hashes[None, a : a + columns], np.log(weights[a : a + columns]).astype(np.float32)[None, :]
        x = (h ^ seeds) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        parts = x.view(np.uint16).reshape(n_samples, -1, 4)
        r = gamma[parts[:, :, 3]]
        b = parts[:, :, 2] * np.float32(1 / 65536)
        t = np.floor(log_s / r + b)
        value = log_gamma[parts[:, :, 1]] - r * (t - b + 1)
        at = value.argmin(1)
        least = value[rows, at]
        better = least < best
        best[better] = least[better]
        taken[better] = mix(h[0, at] + t[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[better]
    return taken


def band_keys(samples: np.ndarray, how: Weighted) -> np.ndarray:
    x = samples.reshape(how.bands, how.rows)
    key = np.arange(how.bands, dtype=np.uint64)
    for j in range(how.rows):
        key = mix(key * np.uint64(31) + x[:, j])
    return key.view(np.int64)


def digest(text) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def tag(copy) -> Column:
    """The part of a digest that tells the texts of one doc_id apart."""
    return F.xxhash64(copy)


def signatures(docs: DataFrame, idf, how: Weighted) -> DataFrame:
    """(doc_id, copy, size, keys): the text's digest, its bytes, and its band keys; rows without doc_id or text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            keys: list = []
            for _, _, s in slices(batch.column("text")):
                text, hashes, counts = text_shingles(s, how.width)
                weights = counts * table[counter_of(hashes)]
                edges = np.searchsorted(text, np.arange(s.n + 1))
                for d in range(s.n):
                    a, b = edges[d], edges[d + 1]
                    keys.append(band_keys(signature(hashes[a:b], weights[a:b], how.bands * how.rows), how) if b > a else [])
            if batch.num_rows:
                kept = [batch.column(c) for c in ("doc_id", "copy", "size")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "copy", "size", "keys"])

    known = docs.where("doc_id is not null and text is not null")
    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest("text").alias("copy"), F.octet_length("text").cast("long").alias("size"))
    return rows.mapInArrow(run, "doc_id long, copy binary, size long, keys array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tag, text) of wanted texts (node, tag): one row of each."""
    ids = wanted.select(F.col("node").alias("doc_id")).distinct()
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_or_shuffled(ids), "doc_id", "left_semi")
    rows = rows.select(F.col("doc_id").alias("node"), tag(digest("text")).alias("tag"), "text").dropDuplicates(["node", "tag"])
    return rows.join(wanted.select("node", "tag").distinct(), ["node", "tag"], "left_semi")


def candidates(members: DataFrame, how: Weighted) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, tag_a, b, tag_b), a < b, of members (node, tag, key, size); and the members of buckets beyond `all_pairs`."""
    first = F.min_by(F.struct("node", "tag"), F.struct(F.xxhash64("node", "tag", "key"), "node", "tag")).alias("first")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), first).where("n > 1")
    shared = stored(members.join(sizes, "key"), "shared")
    small, large = shared.where(f"n <= {how.all_pairs}"), shared.where(f"n > {how.all_pairs}")
    one = small.select("key", F.col("node").alias("a"), F.col("tag").alias("tag_a"))
    within = one.join(small.select("key", F.col("node").alias("b"), F.col("tag").alias("tag_b")), "key").where("a < b").select(*PAIR)
    # buckets of the same members get different centres, so a node is held against several of its neighbours
    own = F.struct("node", "tag")
    low, high = F.least("first", own), F.greatest("first", own)
    star = large.where("node != first.node").select(low.alias("low"), high.alias("high"))
    star = star.select(F.col("low.node").alias("a"), F.col("low.tag").alias("tag_a"), F.col("high.node").alias("b"), F.col("high.tag").alias("tag_b"))
    return within.unionAll(star).distinct(), large.select("node", "tag", "key", "size")


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two sets of (hashes in order, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least, n = np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64), int(both.sum())
    return float(least / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least)), n / (len(a[0]) + len(b[0]) - n)


def weighted_sets(column: pa.Array, table: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    found = []
    for _, _, s in slices(column):
        text, hashes, counts = text_shingles(s, width)
        weights = counts * table[counter_of(hashes)]
        edges = np.searchsorted(text, np.arange(s.n + 1))
        found += [(hashes[edges[d] : edges[d + 1]], weights[edges[d] : edges[d + 1]]) for d in range(s.n)]
    return found


def verified(pairs: DataFrame, docs: DataFrame, idf, how: Weighted) -> DataFrame:
    """(a, b) of the pairs whose weighted or plain Jaccard similarity reaches the threshold."""
    ends = [pairs.select(F.col(x).alias("node"), F.col(f"tag_{x}").alias("tag")) for x in "ab"]
    texts = stored(texts_of(docs, ends[0].unionAll(ends[1]).distinct()), "texts")
    both = pairs
    for x in "ab":
        both = both.join(texts.select(F.col("node").alias(x), F.col("tag").alias(f"tag_{x}"), F.col("text").alias(f"text_{x}")), [x, f"tag_{x}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            one, two = (weighted_sets(batch.column(c), table, how.width) for c in ("text_a", "text_b"))
            yield batch.select(["a", "b"]).filter(pa.array([max(alike(x, y)) >= how.similarity for x, y in zip(one, two)], pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]], common: int = 32, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Weighted and plain intersections of all pairs of sets of (hashes, weights).

    Hashes held by few sets are counted pair by pair, the others by products of
    matrices of presence, `columns` at a time. Weights of a hash are taken in layers:
    the least of two weights is the sum of the layers that both reach.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    hashes, weights = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets]).astype(np.float64)
    order = np.lexsort((-weights, hashes))
    owner, hashes, weights = owner[order], hashes[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    held = np.diff(np.append(first, len(hashes)))
    heavy, plain = np.zeros(n * n), np.zeros(n * n)
    rare = np.repeat(held < common, held)
    o, h, w = owner[rare], hashes[rare], weights[rare]
    for step in range(1, min(common, len(o))):
        at = np.flatnonzero(h[step:] == h[:-step])
        if not len(at):
            break
        code = np.minimum(o[at], o[at + step]) * n + np.maximum(o[at], o[at + step])
        plain += np.bincount(code, minlength=n * n)
        heavy += np.bincount(code, weights=w[at + step], minlength=n * n)  # weights fall along a hash
    heavy, plain = heavy.reshape(n, n), plain.reshape(n, n)
    shared = np.flatnonzero(held >= common)
    for a in range(0, len(shared), columns):
        part = shared[a : a + columns]
        column = np.repeat(np.arange(len(part)), held[part])
        rows = np.concatenate([np.arange(first[i], first[i] + held[i]) for i in part])
        present = np.zeros((n, len(part)), np.float32)
        present[owner[rows], column] = 1
        plain += np.triu(present @ present.T, 1)
        left = weights[rows]
        while len(rows):
            held_by, column = np.unique(column, return_inverse=True)
            layer = np.full(len(held_by), np.inf)
            np.minimum.at(layer, column, left)
            present = np.zeros((n, len(held_by)))
            present[owner[rows], column] = np.sqrt(layer)[column]
            heavy += np.triu(present @ present.T, 1)
            left = left - layer[column]
            more = left > 0
            rows, column, left = rows[more], column[more], left[more]
    return heavy, plain


def links_between(sets: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, over roots, of the links between sets of different roots."""
    full = [i for i, (h, _) in enumerate(sets) if len(h)]
    sets, root = [sets[i] for i in full], root[full]
    if len(sets) < 2:
        return []
    heavy, plain = overlaps(sets)
    size, weight = np.array([len(h) for h, _ in sets]), np.array([w.sum(dtype=np.float64) for _, w in sets])
    found = np.maximum(heavy / (weight[:, None] + weight[None, :] - heavy), plain / (size[:, None] + size[None, :] - plain))
    a, b = np.nonzero(np.triu((found >= similarity - 1e-6) & (root[:, None] != root[None, :]), 1))
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x] = parent.get(parent[x], parent[x])
        return x

    links = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y and (found[i, j] >= similarity + 1e-6 or max(alike(sets[i], sets[j])) >= similarity):  # sums differ in their last digits
            parent[max(x, y)] = min(x, y)
            links.append((min(x, y), max(x, y)))
    return links


def missed_links(large: DataFrame, roots: DataFrame, docs: DataFrame, idf, how: Weighted) -> DataFrame:
    """Links (a, b), a < b, between roots of texts that share a large bucket and are in different classes so far.

    A bucket's largest class, and its other texts, are split by hash into blocks of about
    `block_bytes` or `block_texts`; a task takes two blocks, of which at least one is of other texts.
    """
    known = stored(large.join(roots, "node", "left").select("key", "node", "tag", "size", F.coalesce("root", "node").alias("root")), "large")
    by_class = known.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = by_class.groupBy("key").agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > top.n")
    count = lambda size, n: F.greatest(F.ceil(size / how.block_bytes), F.ceil(n / how.block_texts), F.lit(1)).cast("long")
    plan = top.select("key", F.col("top.root").alias("top"), count(F.col("size") - F.col("top.size"), F.col("n") - F.col("top.n")).alias("others"), count(F.col("top.size"), F.col("top.n")).alias("mains"))
    block = F.when(F.col("root") == F.col("top"), F.col("others") + F.pmod(F.xxhash64("node", "tag", "key"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node", "tag", "key"), F.col("others")))
    last = F.when(F.col("root") == F.col("top"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    # a task holds all pairs of its two blocks, so a block needs no task with itself
    open_ = known.join(plan, "key").withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last))).where("i != j")
    tasks = stored(open_.select("key", "node", "tag", "root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), "blocks")
    texts = texts_of(docs, tasks)

    def run(pdf):
        sets = weighted_sets(pa.array(pdf["text"], pa.string()), idf.value, how.width)
        return pd.DataFrame(links_between(sets, pdf["root"].to_numpy(), how.similarity), columns=["a", "b"], dtype="int64")

    return tasks.join(texts, ["node", "tag"]).groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of links (a, b), a < b.

    Large-star and small-star steps in turn: each rehangs neighbours under the least
    node seen, with sums over distinct edges only, until no edge changes.
    """
    edges, before = stored(links.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "edges"), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u hang under the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u, hang under the least of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame, how: Weighted = Weighted()) -> DataFrame:
    """(doc_id, class_id) for every row; class_id is the least doc_id of the document's class."""
    spark = docs.sparkSession
    prepare(spark)
    idf = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(docs, how)))
    found = stored(signatures(docs, idf, how), "signatures")
    nodes = found.groupBy("copy").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = stored(nodes.withColumn("tag", tag("copy")), "nodes")
    pairs, large = candidates(nodes.select("node", "tag", "size", F.explode("keys").alias("key")), how)
    links = verified(stored(pairs, "pairs"), docs, idf, how)
    same = stored(found.select("doc_id", "copy").join(nodes.select("copy", "node"), "copy").select("doc_id", "node").distinct(), "members")
    # the texts of a document with several are linked, over the least of their nodes
    several = stored(same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a != last").select("doc_id", "a"), "several")
    own = same.join(small_or_shuffled(several), "doc_id").where("node != a").select("a", F.col("node").alias("b"))
    roots = components(links.unionAll(own))
    missed = stored(missed_links(large, roots, docs, idf, how), "missed")
    if missed.limit(1).count():
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(missed))
    known = same.groupBy("doc_id").agg(F.min("node").alias("node")).join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))
    return docs.select("doc_id").join(known, "doc_id", "left").select(F.col("doc_id").cast("long"), F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"))


def keep(docs: DataFrame, how: Weighted = Weighted()) -> DataFrame:
    """One document of each class (its least doc_id), with all its columns."""
    own = F.col("doc_id").cast("long").alias("_own_id")
    found = stored(classes(docs, how).where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")), "classes")
    dropped = found.where("doc_id != class_id").select(F.col("doc_id").alias("_own_id"))
    repeated = found.where("doc_id = class_id and n > 1").select(F.col("doc_id").alias("_own_id"))
    rows = docs.select(own, F.struct("*").alias("_row"))
    leave = stored(dropped.unionAll(repeated), "left-out")
    kept = rows.join(small_or_shuffled(leave), "_own_id", "left_anti").select("_row.*")
    if not repeated.limit(1).count():
        return kept
    again = rows.join(small_or_shuffled(repeated), "_own_id").groupBy("_own_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.unionAll(again.select("_row.*"))
