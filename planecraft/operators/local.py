"""Local alignment: tiles of planes are correlated pair by pair, doubtful ones filled from their neighbours, and the shifts drawn out to a map that a plane is read through.

Tiles overlap by half: four tilings, each shifted by half a tile, interleaved in one grid. They are cut inside their plane's
row and are rows of their own, so tiles of one plane are dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planecraft.operators.fitting import images, in_portions
from planecraft.operators.kernels import cubic, places
from planecraft.operators.reduce import moments
from planecraft.operators.registration import shift_between
from planecraft.plans.shipping import ship
from planecraft.plans.storage import checked

SHIFTS = "z long, w long, ny int, nx int, i int, j int, y0 int, x0 int, variance double, quality double, dy double, dx double, accepted boolean"
MAPS = "z long, w long, ny int, nx int, dy array<double>, dx array<double>"


def starts(n: int, size: int, shifted: bool) -> list[int]:
    """Where the tiles of an axis begin; a shifted tiling begins half a tile later."""
    half = size // 2
    first = max((n - size * (n // size)) // 2, half) - (0 if shifted else half)
    return [first + k * size for k in range(n // size) if first + (k + 1) * size <= n]


def variance(data: Column) -> Column:
    m = moments(data)
    return m["q"] / m["n"] - m["s"] * m["s"] / (m["n"] * m["n"])


def tiles(planes: DataFrame, ny: int, nx: int, size: int) -> DataFrame:
    """(z, w, ny, nx, i, j, y0, x0, spread, data): the tiles of planes of ny x nx pixels, and their plane's variance."""
    places = [(2 * a + s, 2 * b + t, y, x) for s in (0, 1) for t in (0, 1) for a, y in enumerate(starts(ny, size, bool(s))) for b, x in enumerate(starts(nx, size, bool(t)))]
    spots = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("i", "j", "y0", "x0"), p)]) for p in places])
    rows = planes.where((F.col("ny") == ny) & (F.col("nx") == nx)).select("z", "w", "ny", "nx", "data", variance(F.col("data")).alias("spread"), F.explode(spots).alias("t")).select("z", "w", "ny", "nx", "t.*", "spread", "data")
    line = lambda r: F.slice("data", (F.col("y0") + r) * nx + F.col("x0") + 1, size)
    return rows.withColumn("data", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), line)))


def tile_shifts(own: DataFrame, reference: DataFrame, size: int, share: float = 0.1, reach: float = 5.0, least: float = 0.02) -> DataFrame:
    """Shift of each tile against the reference's at the same place (z, i, j). Accepted are tiles whose inner part varies by a share of the planes' variance, with a shift within reach and a clear peak."""
    ship(own.sparkSession)
    other = reference.select("z", "i", "j", F.col("data").alias("ref"), F.col("spread").alias("ref_spread"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SHIFTS.split(", ")]
        types = [pa.int64(), pa.int64()] + [pa.int32()] * 6 + [pa.float64()] * 4 + [pa.bool_()]
        inner = (slice(size // 4, size - size // 4),) * 2
        for batch in batches:
            flat = batch.drop_columns(["ny", "nx"]).append_column("ny", pa.array([size] * batch.num_rows)).append_column("nx", pa.array([size] * batch.num_rows))
            rows = []
            keys = zip(*(batch.column(c).to_pylist() for c in names[:8]))
            for key, a, b, s, t in zip(keys, images(flat), images(flat, "ref"), batch.column("spread").to_pylist(), batch.column("ref_spread").to_pylist()):
                v = float((a[inner].var() + b[inner].var()) / 2)
                (dy, dx), quality = shift_between(a, b, reach=reach + 1, width=4) if v > share * (s + t) / 2 else (np.zeros(2), 0.0)
                good = quality >= least and bool(np.hypot(dy, dx) < reach)
                rows.append((*key, v, quality, float(dy) if good else 0.0, float(dx) if good else 0.0, good))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    pairs = own.join(other, ["z", "i", "j"]).selectExpr("z", "cast(w as bigint) AS w", "ny", "nx", "i", "j", "y0", "x0", "spread", "ref_spread", "data", "ref")
    return pairs.mapInArrow(run, SHIFTS)


def grid_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shifts (2, rows, columns) and acceptance on the grid of tiles that are there."""
    i, j = np.unique(pdf["i"], return_inverse=True)[1], np.unique(pdf["j"], return_inverse=True)[1]
    shift, good = np.zeros((2, i.max() + 1, j.max() + 1)), np.zeros((i.max() + 1, j.max() + 1), bool)
    shift[0, i, j], shift[1, i, j], good[i, j] = pdf["dy"], pdf["dx"], pdf["accepted"]
    return shift, good, np.stack((i, j))


def filled_grid(shift: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Holes take the mean of their accepted neighbours, ring by ring from the accepted tiles outwards; without any all shifts are 0."""
    shift, good = np.where(good, shift, 0.0), good.copy()
    while not good.all() and good.any():
        n, total = np.zeros(good.shape), np.zeros(shift.shape)
        padded, known = np.pad(np.where(good, shift, 0.0), ((0, 0), (1, 1), (1, 1))), np.pad(good, 1)
        for a in range(3):
            for b in range(3):
                n += known[a : a + good.shape[0], b : b + good.shape[1]]
                total += padded[:, a : a + good.shape[0], b : b + good.shape[1]]
        new = ~good & (n > 0)
        shift[:, new] = total[:, new] / n[new]
        good |= new
    return shift


def median_grid(shift: np.ndarray, good: np.ndarray, width: int = 5) -> np.ndarray:
    """Holes take the median of the width x width tiles about them, edges mirrored."""
    half = width // 2
    padded = np.pad(shift, ((0, 0), (half, half), (half, half)), "symmetric")
    around = np.stack([padded[:, a : a + shift.shape[1], b : b + shift.shape[2]] for a in range(width) for b in range(width)])
    return np.where(good, shift, np.median(around, 0))


def drawn_out(shift: np.ndarray, middles: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Shifts between the tiles' middles in equal steps, beyond the outer ones as at them."""
    out = np.stack([np.stack([np.interp(np.arange(shape[1]), middles[1], row) for row in s]) for s in shift])
    return np.stack([np.stack([np.interp(np.arange(shape[0]), middles[0], column) for column in s.T], 1) for s in out])


def displacement(shifts: DataFrame, size: int, fill: str = "neighbours") -> DataFrame:
    """A map of shifts for every plane, from its tiles (of one plane, a bounded number): (z, w, ny, nx, dy, dx)."""
    ship(shifts.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shift, good, _ = grid_of(pdf)
        shift = filled_grid(shift, good) if fill == "neighbours" else median_grid(shift, good)
        middles = tuple(np.unique(pdf[c]) + (size - 1) / 2 for c in ("y0", "x0"))
        shape = int(pdf["ny"].iloc[0]), int(pdf["nx"].iloc[0])
        dy, dx = drawn_out(shift, middles, shape)
        return pd.DataFrame({"z": pdf["z"].iloc[:1], "w": pdf["w"].iloc[:1], "ny": shape[0], "nx": shape[1], "dy": [dy.ravel()], "dx": [dx.ravel()]})

    return shifts.groupBy("z", "w").applyInPandas(run, MAPS)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at places between pixels; 0 outside."""
    iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx, padded = y - iy, x - ix, np.pad(image, 1)
    at = lambda a, b: padded[np.clip(iy + a + 1, 0, image.shape[0] + 1), np.clip(ix + b + 1, 0, image.shape[1] + 1)]
    return at(0, 0) * (1 - fy) * (1 - fx) + at(0, 1) * (1 - fy) * fx + at(1, 0) * fy * (1 - fx) + at(1, 1) * fy * fx


def remapped(planes: DataFrame, maps: DataFrame, order: int = 1, params: DataFrame | None = None) -> DataFrame:
    """Planes shifted by the map of their (z, w): the value at (y - dy, x - dx) comes to (y, x), bilinear or by cubic splines (order 3).

    With `params` (w, ty, tx, r, my, mx), a row for each channel, the map comes on top of their affine map; channels without any have the map alone.
    """
    ship(planes.sparkSession)
    rest = {"ty": 0.0, "tx": 0.0, "r": 0.0, "my": 1.0, "mx": 1.0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches):
            made = []
            values = zip(*(batch.column(c).to_pylist() for c in rest))
            for a, dy, dx, p in zip(images(batch), images(batch, "dy"), images(batch, "dx"), values):
                y, x = places(*a.shape, *p)
                made.append((sampled if order == 1 else cubic)(a, y - dy, x - dx).ravel())
            kept = batch.select(["z", "w", "ny", "nx"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(made, pa.list_(pa.float64()))], ["z", "w", "ny", "nx", "data"])

    rows = planes.selectExpr("z", "cast(w as bigint) AS w", "ny", "nx", "data").join(maps.select("z", "w", "dy", "dx"), ["z", "w"])
    if params is not None:
        rows = rows.join(checked(params.select(F.col("w").cast("long").alias("w"), *rest), "parameters"), "w", "left")
    rows = rows.select("z", "w", "ny", "nx", "data", "dy", "dx", *[(F.coalesce(c, F.lit(v)) if params is not None else F.lit(v)).alias(c) for c, v in rest.items()])
    return rows.mapInArrow(run, "z long, w long, ny int, nx int, data array<double>")
