"""The third layout: images cut into blocks, for planes that are larger than a row should be.

A block is a row (image keys, by, bx, ny, nx, data). Before an operation looks beyond its block, each
block sends strips of its edges to its eight neighbours and gets theirs: only edges are shuffled
between blocks. A pixel whose block is missing, as beyond the image's edge, is given the value of the
nearest pixel in the next block beside, else in the next above or below, else in the own block; so an
image goes on as its outermost pixels do. Blocks of an image have one size, but for the last ones of a
row or column, which may be smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.plans.shipping import ship

ROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def cut(planes: DataFrame, size: int, *keys: str) -> DataFrame:
    """Blocks of planes (keys, ny, nx, data) that are rows still."""
    count = lambda n: F.ceil(F.col(n) / size).cast("int")
    spots = F.flatten(F.transform(F.sequence(F.lit(0), count("ny") - 1), lambda a: F.transform(F.sequence(F.lit(0), count("nx") - 1), lambda b: F.struct(a.alias("by"), b.alias("bx")))))
    rows = planes.select(*keys, F.col("ny").alias("h"), F.col("nx").alias("w_"), "data", F.explode(spots).alias("s")).select(*keys, "h", "w_", "data", "s.*")
    rows = rows.withColumn("ny", F.least(F.lit(size), F.col("h") - F.col("by") * size)).withColumn("nx", F.least(F.lit(size), F.col("w_") - F.col("bx") * size))
    line = lambda r: F.slice("data", (F.col("by") * size + r) * F.col("w_") + F.col("bx") * size + 1, F.col("nx"))
    return rows.select(*keys, "by", "bx", "ny", "nx", F.flatten(F.transform(F.sequence(F.lit(0), F.col("ny") - 1), line)).alias("data"))


def whole(blocks: DataFrame, *keys: str) -> DataFrame:
    """Planes of all blocks of an image, as rows: for images that a row can hold."""
    held = F.array_sort(F.collect_list(F.struct("by", "bx", "ny", "nx", "data")))
    rows = blocks.groupBy(*keys).agg(held.alias("b"), F.sum(F.when(F.col("bx") == 0, F.col("ny"))).cast("int").alias("ny"), F.sum(F.when(F.col("by") == 0, F.col("nx"))).cast("int").alias("nx"))
    one_row = lambda a: F.filter("b", lambda s: s["by"] == a)
    line = lambda a: F.flatten(F.transform(F.sequence(F.lit(0), one_row(a)[0]["ny"] - 1), lambda r: F.flatten(F.transform(one_row(a), lambda s: F.slice(s["data"], r * s["nx"] + 1, s["nx"])))))
    last = F.array_max(F.transform("b", lambda s: s["by"]))
    return rows.select(*keys, "ny", "nx", F.flatten(F.transform(F.sequence(F.lit(0), last), line)).alias("data"))


def _edge(margin: int, dy: int, dx: int):
    """The strip of a block that its neighbour at (dy, dx) wants: its height, width and data."""
    h, w = F.least(F.lit(margin), "ny") if dy else F.col("ny"), F.least(F.lit(margin), "nx") if dx else F.col("nx")
    y, x = (F.col("ny") - h if dy == 1 else F.lit(0)), (F.col("nx") - w if dx == 1 else F.lit(0))
    rows = F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.slice("data", (y + r) * F.col("nx") + x + 1, w))
    return F.struct((F.col("by") + dy).alias("by"), (F.col("bx") + dx).alias("bx"), F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), h.cast("int").alias("h"), w.cast("int").alias("w"), F.flatten(rows).alias("data")).alias("strip"))


def with_edges(blocks: DataFrame, margin: int, *keys: str) -> DataFrame:
    """Blocks and the strips that their neighbours sent (dy, dx: where the neighbour lies)."""
    sent = blocks.select(*keys, F.explode(F.array(*[_edge(margin, dy, dx) for dy, dx in ROUND])).alias("e")).select(*keys, "e.*")
    got = sent.groupBy(*keys, "by", "bx").agg(F.collect_list("strip").alias("strips"))  # eight at most
    return blocks.join(got, [*keys, "by", "bx"], "left")


def padded(own: np.ndarray, strips: list[dict], margin: int) -> np.ndarray:
    """A block with `margin` pixels about it. Strips above and below come first, then those beside, then corners; each goes on as its last pixels do."""
    out = np.pad(own, margin, "edge")
    ny, nx = own.shape
    there = {-1: slice(0, margin), 1: slice(-margin, None)}
    for s in sorted(strips or (), key=lambda s: (s["dy"] != 0 and s["dx"] != 0, s["dx"] != 0)):
        dy, dx = s["dy"], s["dx"]
        strip = np.asarray(s["data"], float).reshape(s["h"], s["w"])
        outward = [((margin - n, 0) if d < 0 else (0, margin - n)) if d else (margin, margin) for d, n in ((dy, s["h"]), (dx, s["w"]))]
        out[there.get(dy, slice(None)), there.get(dx, slice(None))] = np.pad(strip, outward, "edge")
    return out


def filtered(blocks: DataFrame, margin: int, kernel: Callable[[np.ndarray], np.ndarray], *keys: str) -> DataFrame:
    """Blocks after an operation that needs `margin` pixels about each pixel: `kernel` gets a block with them, and returns the block.

    A strip comes from the next block only, so blocks have to be at least `margin` wide but for the last.
    """
    ship(blocks.sparkSession)
    names = [*keys, "by", "bx", "ny", "nx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for ny, nx, data, strips in zip(*(batch.column(c).to_pylist() for c in ("ny", "nx")), batch.column("data"), batch.column("strips")):
                own = data.values.to_numpy(zero_copy_only=False).reshape(ny, nx)
                made.append(kernel(padded(own, strips.as_py(), margin)).ravel())
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(made, pa.list_(pa.float64()))], [*names, "data"])

    rows = with_edges(blocks.select(*names, F.col("data").cast("array<double>").alias("data")), margin, *keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*names).schema)
    return rows.mapInArrow(run, kinds + ", data array<double>")


def weighted(weights: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """Means over rows and columns with the same weights; an odd number of them."""
    half = len(weights) // 2

    def run(a: np.ndarray) -> np.ndarray:
        ny, nx = a.shape[0] - 2 * half, a.shape[1] - 2 * half
        down = sum(k * a[i : i + ny] for i, k in enumerate(weights))
        return sum(k * down[:, i : i + nx] for i, k in enumerate(weights))

    return run


def steepness(a: np.ndarray) -> np.ndarray:
    """Length of the gradient by central differences; needs one pixel about."""
    dy, dx = (a[2:, 1:-1] - a[:-2, 1:-1]) / 2, (a[1:-1, 2:] - a[1:-1, :-2]) / 2
    return np.hypot(dy, dx)


def gaussian(sigma: float) -> list[float]:
    """Weights of a smoothing of that width, out to three sigma."""
    half = max(int(np.ceil(3 * sigma)), 1)
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def smoothed(blocks: DataFrame, weights: Sequence[float], *keys: str) -> DataFrame:
    return filtered(blocks, len(weights) // 2, weighted(weights), *keys)


def gradient(blocks: DataFrame, *keys: str) -> DataFrame:
    return filtered(blocks, 1, steepness, *keys)
