"""Holes of a grid of tile shifts, filled from the tiles that were accepted, in rounds.

In round r, from 1 on, a hole takes the mean of the known tiles at most r rows and columns away,
divided by 2**(r - 1): what is brought from farther counts less. Within r tiles of the first row or
column the window reaches no tiles before its own, and past the last r - 1 none behind its own, as the
definition says. What is known is never touched again. A plane without an accepted tile stays as it is.

Spark deals the tiles to their planes. A plane's grid is one row, as the plane is: rounds reach all over
it, and a join for each round would move every hole's window. A window is a run of rows by a run of
columns, so the sums of a round are two products with bands of ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.plans.shipping import ship

#: Tiles that a task fills at once.
TILES = 1 << 18


def band(n: int, r: int) -> np.ndarray:
    """(n, n): 1 where a tile's window of round r holds the other tile."""
    i, k = np.arange(n)[:, None], np.arange(n)
    return ((k >= i - np.where(i < r, 0, r)) & (k <= i + np.where((i >= r) & (i > n - r), 0, r))).astype(float)


def rounds(shifts: np.ndarray, count: np.ndarray, known: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means (2, planes, ni, nj), whether they hold a value, and rounds (planes, ni, nj; -1: never) from sums of shifts, the numbers of values in them, which tiles are accepted, and which are there at all."""
    ni, nj = known.shape[1:]
    mean = np.where(count > 0, shifts / np.maximum(count, 1), np.nan)
    found, weight, r = np.where(known > 0, 0, -1), known.astype(float), 0
    while (left := there & (found < 0) & (weight > 0).any((1, 2))[:, None, None]).any():
        r += 1
        down, across = band(ni, r), band(nj, r).T
        spread = lambda x: down @ x @ across  # noqa: E731, B023
        new = left & (spread(weight) > 0.5)
        if not new.any():
            if r >= max(ni, nj):  # windows grow no more
                break
            continue
        number = spread(count)
        finite = np.isfinite(shifts)
        total = spread(np.where(finite, shifts, 0.0))
        if not finite.all():  # numbers that aren't finite stay within their windows
            nan, high, low = (spread(x.astype(float)) > 0.5 for x in (np.isnan(shifts), shifts == np.inf, shifts == -np.inf))
            total = np.where(nan | high & low, np.nan, np.where(high, np.inf, np.where(low, -np.inf, total)))
        made = np.where(number > 0.5, total / np.maximum(number, 1) / 2.0 ** (r - 1), np.nan)
        mean, found = np.where(new, made, mean), np.where(new, r, found)
        weight = np.where(new, 1.0, weight)
        filled = (number > 0.5) & new
        shifts, count = np.where(new, np.where(filled, made, 0.0), shifts), np.where(new, filled, count)
    return mean, count > 0, found


def fill(tiles: DataFrame, *keys: str) -> DataFrame:
    """Tiles (keys, i, j, dy, dx, accepted), i and j from 0, with `round`: 0 for accepted tiles, null where nothing is known."""
    ship(tiles.sparkSession)
    columns = ["i", "j", "dy", "dx", "accepted"]
    tile = F.struct(*[F.col(c).cast("long").alias(c) for c in "ij"], *[F.col(c).cast("double").alias(c) for c in ("dy", "dx")], F.coalesce("accepted", F.lit(False)).alias("accepted"))
    planes = tiles.groupBy(*keys).agg(F.collect_list(tile).alias("tiles"))
    held = planes.withColumn("spot", F.struct(*keys)).select("spot", "tiles")
    kind = pa.list_(pa.struct([("dy", pa.float64()), ("dx", pa.float64()), ("round", pa.int32()), ("i", pa.int64()), ("j", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("tiles").offsets.to_numpy())
            parts = np.cumsum(sizes) // TILES
            for a, b in zip(np.flatnonzero(np.diff(parts, prepend=-1)), [*np.flatnonzero(np.diff(parts)) + 1, len(sizes)]):
                yield filled(batch.slice(a, b - a), kind)

    out = "spot " + held.schema["spot"].dataType.simpleString() + ", made array<struct<dy: double, dx: double, round: int, i: bigint, j: bigint>>"
    made = held.mapInArrow(run, out).select("spot.*", F.explode("made").alias("t"))
    types = dict(tiles.dtypes)
    return made.select(*keys, *[F.col(f"t.{c}").cast(types[c]).alias(c) for c in columns[:2]], "t.dy", "t.dx", "t.round")


def filled(batch: pa.RecordBatch, kind: pa.DataType) -> pa.RecordBatch:
    """A batch of planes, those of one size together."""
    column = batch.column("tiles")
    flat = column.flatten()
    plane = np.repeat(np.arange(len(batch)), np.diff(column.offsets.to_numpy()))
    i, j = (flat.field(c).to_numpy() for c in "ij")
    accepted = flat.field("accepted").to_numpy(zero_copy_only=False)
    values = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("dy", "dx")])
    valid = np.stack([flat.field(c).is_valid().to_numpy(zero_copy_only=False) for c in ("dy", "dx")])
    shape = np.zeros((len(batch), 2), np.int64)
    np.maximum.at(shape, plane, np.stack((i, j), 1) + 1)
    dy, found = values.copy(), np.where(accepted, 0, -1)
    empty = ~valid
    for size in np.unique(shape, axis=0):
        mine = np.flatnonzero((shape[plane] == size).all(1))
        own, p = np.unique(plane[mine], return_inverse=True)
        known = np.zeros((len(own), *size))
        shifts, count = np.zeros((2, *known.shape)), np.zeros((2, *known.shape))
        good = accepted[mine]
        at = p[good], i[mine][good], j[mine][good]
        np.add.at(known, at, 1)
        for c in range(2):
            some = valid[c, mine][good]
            np.add.at(shifts[c], tuple(x[some] for x in at), values[c, mine][good][some])
            np.add.at(count[c], tuple(x[some] for x in at), 1)
        there = np.zeros(known.shape, bool)
        there[p, i[mine], j[mine]] = True
        mean, held, number = rounds(shifts, count, known, there)
        hole = mine[~good]
        at = p[~good], i[hole], j[hole]
        new = number[at] > 0
        found[hole] = np.where(new, number[at], -1)
        # a hole at an accepted tile's place, or in a plane without any, stays as it is
        dy[:, hole[new]] = mean[(slice(None), *at)][:, new]
        empty[:, hole[new]] = ~held[(slice(None), *at)][:, new]
    made = pa.StructArray.from_arrays([*(pa.array(v, pa.float64(), mask=e) for v, e in zip(dy, empty)), pa.array(found, pa.int32(), mask=found < 0), pa.array(i), pa.array(j)], fields=list(kind.value_type))
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy())))), pa.int32())
    return pa.RecordBatch.from_arrays([batch.column("spot"), pa.ListArray.from_arrays(offsets, made)], ["spot", "made"])
