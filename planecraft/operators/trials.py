"""How well alignment finds known maps: planes are mapped, noise is added in steps, and what is found is held against the truth.

A trial is a row (plane, method, noise), so trials are dealt to tasks whatever the number of planes. Noise is made from
hashes of the plane, the pixel and a seed: a repeated task makes the same noise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planecraft.operators import kernels, local, registration, tile_loop
from planecraft.plans.storage import stored

#: What `registration.aligned` is told for each method.
METHODS = {"quadrants": {}, "simplex": {"least": 10.0, "otherwise": "simplex"}, "logpolar": {"least": 10.0, "otherwise": "logpolar"}, "shift": {"rounds": 0}}


def uniform(seed: int, *keys: Column) -> Column:
    """Numbers between 0 and 1, both left out, from a hash of the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def with_noise(planes: DataFrame, divisors: Sequence[float], deviation: float, seed: int = 1, *keys: str) -> DataFrame:
    """Planes over each divisor with Gaussian noise of one deviation, as rows with `noise`, the divisor."""
    rows = planes.withColumn("noise", F.explode(F.array(*[F.lit(float(d)) for d in divisors])))
    names = [F.col(k) for k in (keys or ("z", "w"))]
    size = lambda i: F.sqrt(-2.0 * F.ln(uniform(seed, *names, F.col("noise"), i)))
    turn = lambda i: F.cos(2 * math.pi * uniform(seed + 1, *names, F.col("noise"), i))
    return rows.withColumn("data", F.transform("data", lambda v, i: v / F.col("noise") + deviation * size(i) * turn(i)))


def deviations(found: DataFrame, truth: dict[str, float], pixel_nm: tuple[float, float], half: tuple[float, float]) -> DataFrame:
    """`found` (ty, tx, r, my, mx) with its differences from the truth in nanometres (dty ... dmx) and their length (total).

    Rotation counts as the way of the point (0, half the width) about the middle, zooms as the way of the edge's middle.
    """
    apart = {c: F.col(c) - truth[c] for c in ("ty", "tx", "r", "my", "mx")}
    across = math.hypot(*half)
    nm = {
        "dty": apart["ty"] * pixel_nm[0],
        "dtx": apart["tx"] * pixel_nm[1],
        "dr": 2 * F.sin(F.radians(F.abs(apart["r"])) / 2) * across * sum(pixel_nm) / 2,
        "dmy": apart["my"] * half[0] * pixel_nm[0],
        "dmx": apart["mx"] * half[1] * pixel_nm[1],
    }
    return found.select("*", *[e.alias(c) for c, e in nm.items()], F.sqrt(sum((e * e for e in nm.values()), F.lit(0.0))).alias("total"))


def compared(planes: DataFrame, truth: dict[str, float], divisors: Sequence[float], deviation: float, methods: Sequence[str] = ("quadrants",), pixel_nm: tuple[float, float] = (80.0, 80.0), seed: int = 1) -> DataFrame:
    """(z, method, noise, ty, tx, r, my, mx, quality, dty ... dmx, total) of planes (z, w, ny, nx, data) of one size, each against itself mapped.

    truth: ty, tx, r, my, mx of the map that brings a plane onto its reference.
    """
    size = planes.select("ny", "nx").first()
    if size is None:
        size = (2, 2)
    mapped = kernels.resampled(planes, {"ty": truth["ty"], "tx": truth["tx"], "degrees": truth["r"], "my": truth["my"], "mx": truth["mx"]}, order=3)
    reference = with_noise(mapped, divisors, deviation, seed + 100)
    moving = with_noise(planes, divisors, deviation, seed)
    # a pair is named by its plane and its noise
    key = (F.col("z") * len(divisors) + F.array_position(F.array(*[F.lit(float(d)) for d in divisors]), F.col("noise")) - 1).cast("long")
    own = moving.select(key.alias("z"), F.lit(0).cast("long").alias("w"), "ny", "nx", "data")
    refs = reference.select(key.alias("z"), F.col("data").alias("ref"))
    made = None
    for m in methods:
        one = registration.aligned(own, refs, **METHODS[m]).select("z", F.lit(m).alias("method"), "ty", "tx", "r", "my", "mx", "quality")
        made = one if made is None else made.unionByName(one)
    noise = F.get(F.array(*[F.lit(float(d)) for d in divisors]), F.pmod(F.col("z"), F.lit(len(divisors))).cast("int"))
    named = made.select(F.floor(F.col("z") / len(divisors)).alias("plane"), "method", noise.alias("noise"), "ty", "tx", "r", "my", "mx", "quality").withColumnRenamed("plane", "z")
    return deviations(named, truth, pixel_nm, (size[0] / 2, size[1] / 2))


def summary(trials: DataFrame) -> DataFrame:
    """(method, noise, n, me, sd, ma): mean, deviation and greatest of the total error over planes."""
    return trials.groupBy("method", "noise").agg(F.count("*").alias("n"), F.avg("total").alias("me"), F.stddev_pop("total").alias("sd"), F.max("total").alias("ma"))


def warps(planes: DataFrame, dy: Sequence[tuple[float, float, float]], dx: Sequence[tuple[float, float, float]], sigma: float) -> DataFrame:
    """(z, w, dy, dx): for every plane a map of shifts that is a sum of Gaussians, each (y, x, height) as a share of the plane's size and in pixels."""
    pixels = F.sequence(F.lit(0), (F.col("ny") * F.col("nx") - 1).cast("int"))

    def hills(peaks: Sequence[tuple[float, float, float]]) -> Column:
        def at(p: Column) -> Column:
            y, x = F.floor(p / F.col("nx")), p % F.col("nx")
            parts = [h * F.exp(-((y - a * F.col("ny")) ** 2 + (x - b * F.col("nx")) ** 2) / (2 * sigma * sigma)) for a, b, h in peaks]
            return sum(parts, F.lit(0.0))

        return F.transform(pixels, at)

    return planes.select("z", F.col("w").cast("long").alias("w"), hills(dy).alias("dy"), hills(dx).alias("dx"))


def local_compared(planes: DataFrame, maps: DataFrame, windows: Sequence[int], pixel_nm: tuple[float, float] = (80.0, 80.0)) -> DataFrame:
    """(z, w, window, regions, me, ma, sd, pearson): planes of one size, each against itself remapped, aligned by tiles down to each window size.

    me, ma and sd are the mean, greatest and deviation of the way in nanometres between found and true shift at the middles of accepted
    tiles; pearson is the correlation of the plane, read through what was found, with its reference. A plane without an accepted tile has none.
    """
    size = planes.select("ny", "nx").first()
    if size is None:
        raise ValueError("there are no planes")
    ny, nx = size
    own = stored(planes.withColumn("w", F.col("w").cast("long")), "planes")
    maps = stored(maps, "maps")
    reference = stored(local.remapped(own, maps, 3), "references")
    out = None
    for window in windows:
        shifts = stored(tile_loop.refined(own, reference, ny, nx, tile_loop.Loop(least_window=window))[0], "shifts")
        width = tile_loop.windows(ny, nx, window)[-1]
        middle = ((F.col("y0") + width // 2) * nx + F.col("x0") + width // 2).cast("int")
        both = shifts.where("accepted").join(maps.withColumnsRenamed({"dy": "true_dy", "dx": "true_dx"}), ["z", "w"])
        way = F.hypot((F.col("dy") - F.get("true_dy", middle)) * pixel_nm[0], (F.col("dx") - F.get("true_dx", middle)) * pixel_nm[1])
        errors = both.select("z", "w", way.alias("way")).groupBy("z", "w").agg(F.count("*").alias("regions"), F.avg("way").alias("me"), F.max("way").alias("ma"), F.stddev_pop("way").alias("sd"))
        made = local.remapped(own, local.displacement(shifts, width), 3)
        pairs = made.join(reference.select("z", "w", F.col("data").alias("ref")), ["z", "w"])
        values = pairs.select("z", "w", F.explode(F.arrays_zip("data", "ref")).alias("v")).groupBy("z", "w").agg(F.corr("v.data", "v.ref").alias("pearson"))
        one = errors.join(values, ["z", "w"]).select("z", "w", F.lit(window).alias("window"), "regions", "me", "ma", "sd", "pearson")
        out = one if out is None else out.unionByName(one)
    return out
