"""Local alignment from coarse to fine: a row of state for each tile, and rounds over the tiles that aren't settled.

Each window size cuts both planes into overlapping tiles once, own tiles with a margin about them. A round
joins the unsettled tiles' state to their pixels, reads the own tile through its shift so far, and adds what
the correlation with the reference's tile still finds. A tile settles when that is small, when it grows (it
is then left out), when its peak is not clear, or after the last round. Only unsettled tiles are in the next
round, whose state is written first, so a lost executor repeats no round before it. Tiles left out are
filled from their neighbours, and a window's shifts are the start of the next, smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.operators import holes
from planecraft.operators.local import sampled, starts, variance
from planecraft.operators.registration import shift_between
from planecraft.plans.shipping import ship
from planecraft.plans.storage import stored


@dataclass(frozen=True)
class Loop:
    """Smallest window, rounds of a window, the shift below which a tile is settled, the longest shift of a round and in all, the share of the planes' variance that a tile must have, and the least clearness of a peak."""

    least_window: int = 32
    rounds: int = 5
    end: float = 0.05
    reach: float = 4.0
    margin: int = 8
    share: float = 0.1
    quality: float = 0.02


def windows(ny: int, nx: int, least: int, most: int = 300) -> list[int]:
    """Even window sizes, halved from half the plane (or `most`) down to `least`."""
    size, out = min(min(ny, nx) // 2, most), []
    while size >= least:
        out.append(size + size % 2)
        size //= 2
    return out


def _places(ny: int, nx: int, size: int) -> list[tuple[int, int, int, int]]:
    """(i, j, y0, x0) of all tiles, numbered along each axis; they overlap by half."""
    ys, xs = (sorted(starts(n, size, False) + starts(n, size, True)) for n in (ny, nx))
    return [(i, j, y, x) for i, y in enumerate(ys) for j, x in enumerate(xs)]


def _cut(planes: DataFrame, ny: int, nx: int, size: int, margin: int) -> DataFrame:
    """(z, w, i, j, y0, x0, spread, tile) of planes of ny x nx; beyond the plane a tile has its nearest pixels."""
    spots = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("i", "j", "y0", "x0"), p)]) for p in _places(ny, nx, size)])
    rows = planes.where((F.col("ny") == ny) & (F.col("nx") == nx)).select("z", F.col("w").cast("long").alias("w"), "data", variance(F.col("data")).alias("spread"), F.explode(spots).alias("s"))
    rows = rows.select("z", "w", F.col("s.i").cast("long").alias("i"), F.col("s.j").cast("long").alias("j"), "s.y0", "s.x0", "spread", "data")
    inside = lambda v, n: F.greatest(F.least(v, F.lit(n - 1)), F.lit(0))
    steps = F.sequence(F.lit(-margin), F.lit(size + margin - 1))
    line = lambda r: F.transform(steps, lambda c: F.get("data", inside(F.col("y0") + r, ny) * nx + inside(F.col("x0") + c, nx)))
    return rows.withColumn("tile", F.flatten(F.transform(steps, line))).drop("data")


STATE = "z long, w long, i long, j long, y0 int, x0 int, dy double, dx double, last double, settled boolean, accepted boolean"


def _round(work: DataFrame, size: int, how: Loop, final: bool) -> DataFrame:
    """New state of the tiles in `work`: state, spread, tile, ref, ref_spread."""
    names = [c.split()[0] for c in STATE.split(", ")]
    types = [*[pa.int64()] * 4, *[pa.int32()] * 2, *[pa.float64()] * 3, pa.bool_(), pa.bool_()]
    m = how.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = (slice(size // 4, size - size // 4),) * 2
        gy, gx = np.mgrid[:size, :size].astype(float)
        for batch in batches:
            rows = []
            state = batch.select(names).to_pylist()
            spread = (np.array(batch.column("spread")) + np.array(batch.column("ref_spread"))) / 2
            for s, own, ref, v in zip(state, batch.column("tile"), batch.column("ref"), spread):
                own = own.values.to_numpy(zero_copy_only=False).reshape(size + 2 * m, size + 2 * m)
                ref = ref.values.to_numpy(zero_copy_only=False).reshape(size, size)
                a = sampled(own, gy + m - s["dy"], gx + m - s["dx"])
                found, clear = np.zeros(2), False
                if (a[inner].var() + ref[inner].var()) / 2 > how.share * v:
                    found, quality = shift_between(a, ref, reach=how.reach + 1, width=4)
                    clear = quality >= how.quality and bool(np.hypot(*found) < how.reach)
                step = float(np.hypot(*found))
                dy, dx = s["dy"] + float(found[0]), s["dx"] + float(found[1])
                if not clear or step > s["last"] or max(abs(dy), abs(dx)) > m - 1:
                    # a tile that was good before keeps its shift; one that never was is left out
                    rows.append((*[s[c] for c in names[:8]], s["last"], True, s["accepted"] and clear))
                else:
                    rows.append((*[s[c] for c in names[:6]], dy, dx, step, step < how.end or final, True))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return work.mapInArrow(run, STATE)


def _start(places: DataFrame, before: DataFrame | None, old: int, size: int) -> DataFrame:
    """The first state of a window: no shift, or the shifts of the larger window between whose tiles the middle of a tile lies."""
    fresh = [F.lit(float("inf")).alias("last"), F.lit(False).alias("settled"), F.lit(False).alias("accepted")]
    keys = ["z", "w", "i", "j", "y0", "x0"]
    if before is None:
        return places.select(*keys, F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"), *fresh)
    first = before.groupBy("z", "w").agg(F.min("y0").alias("fy"), F.min("x0").alias("fx"), F.max("i").alias("ni"), F.max("j").alias("nj"))
    spot = lambda c, f: (F.col(c) + (size - 1) / 2 - F.col(f) - (old - 1) / 2) / (old / 2)
    held = places.join(first, ["z", "w"]).withColumn("gi", F.greatest(F.least(spot("y0", "fy"), F.col("ni")), F.lit(0.0))).withColumn("gj", F.greatest(F.least(spot("x0", "fx"), F.col("nj")), F.lit(0.0)))
    four = F.array(*[F.struct((F.floor("gi") + a).alias("oi"), (F.floor("gj") + b).alias("oj")) for a in (0, 1) for b in (0, 1)])
    near = held.select(*keys, "gi", "gj", F.explode(four).alias("o")).select(*keys, "gi", "gj", "o.*")
    share = (1 - F.abs(F.col("gi") - F.col("oi"))) * (1 - F.abs(F.col("gj") - F.col("oj")))
    old_shifts = before.select("z", "w", F.col("i").alias("oi"), F.col("j").alias("oj"), F.col("dy").alias("a"), F.col("dx").alias("b"))
    mixed = near.withColumn("share", share).where("share > 0").join(old_shifts, ["z", "w", "oi", "oj"])
    return mixed.groupBy(*keys).agg(F.sum(F.col("a") * F.col("share")).alias("dy"), F.sum(F.col("b") * F.col("share")).alias("dx")).select(*keys, "dy", "dx", *fresh)


def refined(own: DataFrame, reference: DataFrame, ny: int, nx: int, how: Loop = Loop()) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Tile shifts of the smallest window (z, w, ny, nx, i, j, y0, x0, dy, dx, accepted), and how many tiles each round had: (window, round, tiles).

    Planes (z, w, ny, nx, data) of other sizes are left out; own planes are paired with the reference of their z.
    """
    ship(own.sparkSession)
    before, size_before, trace = None, 0, []
    for size in windows(ny, nx, how.least_window):
        refs = _cut(reference, ny, nx, size, 0).select("z", "i", "j", F.col("tile").alias("ref"), F.col("spread").alias("ref_spread"))
        pixels = stored(_cut(own, ny, nx, size, how.margin).join(refs, ["z", "i", "j"]), "tiles")
        state = stored(_start(pixels.select("z", "w", "i", "j", "y0", "x0"), before, size_before, size), "state")
        done = []
        for r in range(how.rounds):
            n = state.count()
            if not n:
                break
            trace.append((size, r, n))
            work = state.join(pixels.drop("y0", "x0"), ["z", "w", "i", "j"])
            state = stored(_round(work, size, how, r == how.rounds - 1), "state")
            done.append(state.where("settled"))
            state = state.where("NOT settled")
        settled = done[0] if done else state
        for d in done[1:]:
            settled = settled.unionByName(d)
        settled = stored(settled, "settled")
        filled = holes.fill(settled.select("z", "w", "i", "j", F.when(F.col("accepted"), F.col("dy")).otherwise(0.0).alias("dy"), F.when(F.col("accepted"), F.col("dx")).otherwise(0.0).alias("dx"), "accepted"), "z", "w")
        before = stored(filled.drop("round").join(settled.select("z", "w", "i", "j", "y0", "x0", "accepted"), ["z", "w", "i", "j"]), "window")
        size_before = size
    if before is None:
        raise ValueError("planes are too small for the smallest window")
    return before.select("z", "w", F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), "i", "j", "y0", "x0", "dy", "dx", "accepted"), trace
