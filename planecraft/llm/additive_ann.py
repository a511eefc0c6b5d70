"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one centroid from each of several codebooks of full
dimension. The codebooks are fitted one after the other on the residuals of a bounded
sample; every row is then encoded by beam search over all codebooks, with the inner
products of centroids from a table. Stored with a code is the ratio of the vector's
norm to its code's norm. A query is scored against codes by a lookup table of its
inner products with all centroids, times that ratio. What the code leaves over is coded
a second time, a byte for each dimension, and the length of what is then still missing
is stored: a query's inner product with a row can't be further from the score than that
length. Every row that may by this bound be among the best is reranked by the exact
inner product in double precision, so the result is that of a full search.

The query set is scored against all rows in blocks: a block of queries meets every
block of codes, and of each query and lane those rows leave the task whose greatest
possible score reaches the lane's (k + 1)th least possible one. Directions are coded;
lengths are kept beside them.

Defined results: vectors that are null, empty, zero, or hold a null or a component
that isn't finite take no part; a query meets candidates of its own dimension only.
Equal vectors are one entry of the index, which stands for the `k` + 1 smallest of
their ids; further ones can't be among the k nearest. A vec_id is taken to be unique.
Without candidates there are no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planecraft.llm.jobs import prepare, stored

CODED = ("code", "ratio", "rest", "step", "length", "error")
FOUND = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Additive:
    """Codebooks and their size, the rows that they are fitted on, the beam, the result's size, the blocks, and the rows that a task holds."""

    books: int = 8
    size: int = 256
    sample: int = 10_000
    rounds: int = 8
    beam: int = 8
    k: int = 20
    lanes: int = 4
    query_block: int = 128
    code_block: int = 4096
    held: int = 1 << 20


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, as doubles."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions of rows, and their lengths."""
    top = np.abs(x).max(1)
    x = x / top[:, None]
    length = np.sqrt((x * x).sum(1))
    return x / length[:, None], length * top


def fit(x: np.ndarray, how: Additive) -> np.ndarray:
    """Codebooks (books, size, dim) by k-means on residuals. Fewer vectors than centroids give as many centroids as vectors."""
    rng, rest, books = np.random.default_rng(7), x.astype(np.float32), []
    size = min(how.size, len(x))
    for _ in range(how.books):
        centres = rest[rng.permutation(len(rest))[:size]].copy()
        for _ in range(how.rounds):
            near = (rest @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
            n = np.bincount(near, minlength=size)
            total = np.zeros_like(centres)
            np.add.at(total, near, rest)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), size)])
        near = (rest @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        rest = rest - centres[near]
        books.append(centres)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) by beam search on the squared error, and the norms' ratios."""
    m, size, _ = books.shape
    flat = books.reshape(m * size, -1)
    gram, norms = flat @ flat.T, (flat * flat).sum(1)
    with_x = x.astype(np.float32) @ flat.T
    n = len(x)
    codes, errors = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
    for b in range(m):
        block = slice(b * size, (b + 1) * size)
        cross = sum((gram[codes[:, :, j] + j * size, block] for j in range(b)), np.zeros((n, codes.shape[1], 1), np.float32))
        step = errors[:, :, None] + norms[block] - 2 * with_x[:, None, block] + 2 * cross
        step = np.broadcast_to(step, (n, codes.shape[1], size)).reshape(n, -1)
        width = min(beam, step.shape[1])
        best = np.argpartition(step, width - 1, 1)[:, :width]
        errors = np.take_along_axis(step, best, 1)
        codes = np.concatenate((np.take_along_axis(codes, (best // size)[:, :, None], 1), (best % size)[:, :, None]), 2)
    codes = codes[np.arange(n), errors.argmin(1)]
    coded = sum(books[b][codes[:, b]] for b in range(m))
    return codes.astype(np.uint8), (np.sqrt((x * x).sum(1)) / np.maximum(np.sqrt((coded * coded).sum(1)), 1e-12)).astype(np.float32)


def remainder(x: np.ndarray, codes: np.ndarray, ratios: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What codes times ratios leave of x: bytes (n, dim), their steps, and a bound of the error of a unit query's score in single precision."""
    parts = books[np.arange(len(books)), codes].astype(np.float64)
    ratio = ratios.astype(np.float64)
    rest = x - parts.sum(1) * ratio[:, None]
    steps = np.maximum(np.abs(rest).max(1) / 127, 1e-30).astype(np.float32)
    small = np.clip(np.rint(rest / steps[:, None]), -127, 127).astype(np.int8)
    second = small * steps[:, None].astype(np.float64)
    missing = np.sqrt(((rest - second) ** 2).sum(1))
    size = ratio * np.sqrt((parts * parts).sum(2)).sum(1) + np.sqrt((second * second).sum(1))
    rounding = (x.shape[1] + len(books) + 8) * 2.0**-23 * size  # of sums of that many terms
    return small, steps, (missing + rounding) * (1 + 1e-6)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def entries(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Different vectors (entry, embedding), and (entry, vec_id) with the k + 1 smallest ids of each. A vector's rows are first thinned in 64 lanes."""
    lane = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    keyed = vectors.select("vec_id", F.md5(F.to_json("embedding")).alias("vector"))
    thin = keyed.withColumn("n", F.row_number().over(Window.partitionBy("vector", lane).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    least = thin.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    least = stored(least.withColumn("entry", F.min("vec_id").over(Window.partitionBy("vector"))).select("entry", "vec_id"), "entries")
    firsts = least.where("entry = vec_id").select("entry")
    return vectors.select(F.col("vec_id").alias("entry"), "embedding").join(firsts, "entry"), least


def codes(index: DataFrame, books: np.ndarray, how: Additive) -> DataFrame:
    """(entry, code, ratio, rest, step, length, error) of every entry."""
    kept = index.sparkSession.sparkContext.broadcast(books)  # books x size x dim floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, length = unit(matrix(batch.column("embedding")))
                code, ratio = encode(x, kept.value, how.beam)
                rest, step, error = remainder(x, code, ratio, kept.value)
                yield pa.RecordBatch.from_pydict({"entry": batch.column("entry"), "code": [c.tobytes() for c in code], "ratio": ratio, "rest": [r.tobytes() for r in rest], "step": step, "length": length, "error": error})

    return index.mapInArrow(run, "entry long, code binary, ratio float, rest binary, step float, length double, error double")


def shortlists(queries: DataFrame, coded: DataFrame, books: np.ndarray, how: Additive) -> DataFrame:
    """(query_id, entry): for every query and lane all entries that may be among the k + 1 with the highest inner products."""
    n_queries, n_codes = queries.count(), coded.count()
    query_blocks, code_blocks = -(-n_queries // how.query_block), -(-n_codes // how.code_block)
    q = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, query_blocks))).alias("q")).agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("embedding").alias("vectors"))
    c = coded.groupBy(F.pmod(F.xxhash64("entry"), F.lit(max(1, code_blocks))).alias("c")).agg(F.collect_list("entry").alias("entries"), *[F.collect_list(c).alias(f"{c}s") for c in CODED])
    pairs = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(1, query_blocks) - 1)).cast("array<long>"))).join(q, "q")
    pairs = pairs.withColumn("lane", F.col("c") % how.lanes).repartition("q", "lane").sortWithinPartitions("q", "lane", "c")
    kept = queries.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, now = kept.value, None
        query_ids = vectors = table = least = held = None

        def out() -> pa.RecordBatch:
            row, found, _ = held
            return pa.RecordBatch.from_pydict({"query_id": query_ids[row], "entry": found})

        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                values = lambda c: one.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                key = (one.column("q")[0].as_py(), one.column("lane")[0].as_py())
                if key != now:
                    if now is not None:
                        yield out()
                    query_ids = values("query_ids")
                    vectors = unit(matrix(one.column("vectors").flatten()))[0].astype(np.float32)
                    table = np.einsum("qd,bsd->bsq", vectors, books)  # a row of all queries for each centroid
                    now, least = key, np.full((len(query_ids), how.k + 1), -np.inf)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                code, rest = (np.frombuffer(b"".join(one.column(c).flatten().to_pylist()), t).reshape(-1, n) for c, t, n in (("codes", np.uint8, len(books)), ("rests", np.int8, vectors.shape[1])))
                score = table[0][code[:, 0]]
                for b in range(1, len(books)):
                    score += table[b][code[:, b]]
                score = score.T * values("ratios") + (vectors @ rest.T.astype(np.float32)) * values("steps")
                length, error = values("lengths"), values("errors")
                high = (score + error) * length
                least = np.concatenate((least, (score - error) * length), 1)
                least = np.partition(least, least.shape[1] - how.k - 1, 1)[:, -how.k - 1 :]
                bar = least.min(1)
                row, column = np.nonzero(high >= bar[:, None])
                still = held[2] >= bar[held[0]]
                held = tuple(np.concatenate((old[still], new)) for old, new in zip(held, (row, values("entries")[column], high[row, column])))
                if len(held[0]) > how.held:  # rows that can't be told apart are reranked all
                    yield out()
                    held = tuple(x[:0] for x in held)
        if now is not None:
            yield out()

    return pairs.mapInArrow(run, "query_id long, entry long")


def search(vectors: DataFrame, is_query, how: Additive = Additive()) -> DataFrame:
    """The k candidates with the largest inner products for every row that `is_query` (a Column over vec_id) picks, without the row itself."""
    spark = vectors.sparkSession
    prepare(spark)
    sound = stored(valid(vectors), "vectors")
    found = []
    for (dim,) in sorted(tuple(r) for r in sound.groupBy(F.size("embedding")).count().select("size(embedding)").collect()):
        own = sound.where(F.size("embedding") == dim)
        index, ids = entries(own, how.k)
        index = stored(index, "index")
        rows = index.orderBy(F.xxhash64("entry"), "entry").limit(how.sample).toArrow()  # the fit's bounded sample
        books = fit(unit(matrix(rows["embedding"]))[0], how)
        coded = stored(codes(index, books, how), "codes")
        queries = own.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
        short = shortlists(queries, coded, books, how)
        # the query's own entry may be left off by better ones; its copies are found with it
        exact = short.join(index.withColumnRenamed("embedding", "v"), "entry").join(queries.withColumnRenamed("embedding", "q"), "query_id")
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scored = exact.select("query_id", "entry", score.alias("score"))
        best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry"))).where(F.col("n") <= how.k + 1)
        each = best.join(ids, "entry").where("vec_id != query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found.append(each.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= how.k))
    if not found:
        return spark.createDataFrame([], FOUND)
    result = found[0]
    for x in found[1:]:
        result = result.unionAll(x)
    return result
