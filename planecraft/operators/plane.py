"""Operations inside a plane, as array expressions over its row: no shuffle and no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planecraft.functions.geometry import nearby
from planecraft.operators.reduce import moments


def at(y: Column, x: Column) -> Column:
    """The pixel at (y, x); 0 outside."""
    inside = (y >= 0) & (y < F.col("ny")) & (x >= 0) & (x < F.col("nx"))
    return F.when(inside, F.get("data", (y * F.col("nx") + x).cast("int"))).otherwise(0.0)


def each(planes: DataFrame, value, ny: Column | None = None, nx: Column | None = None, whole: Column | None = None) -> DataFrame:
    """Planes (z, w, ny, nx, data) whose pixels are value(y, x), or value(y, x, w) where w is `whole`, a value of the plane that is found once."""
    ny, nx = ny if ny is not None else F.col("ny"), nx if nx is not None else F.col("nx")
    places = F.sequence(F.lit(0), (ny * nx - 1).cast("int"))
    place = lambda p: (F.floor(p / nx).cast("int"), (p % nx).cast("int"))
    if whole is None:
        data = F.transform(places, lambda p: value(*place(p)))
    else:
        data = F.get(F.transform(F.array(whole), lambda w: F.transform(places, lambda p: value(*place(p), w))), F.lit(0))
    return planes.select("z", "w", data.alias("made"), ny.cast("int").alias("ny2"), nx.cast("int").alias("nx2")).select("z", "w", F.col("ny2").alias("ny"), F.col("nx2").alias("nx"), F.col("made").alias("data"))


def binned(planes: DataFrame, k: int = 2) -> DataFrame:
    """Sums of k x k pixels; what is left over at the edges is dropped, as in the plane's own size."""
    cells = [(i, j) for i in range(k) for j in range(k)]
    return each(planes, lambda y, x: F.round(sum((at(y * k + i, x * k + j) for i, j in cells), F.lit(0.0)), 6), F.floor(F.col("ny") / k), F.floor(F.col("nx") / k))


def shifted(planes: DataFrame, dy: float, dx: float) -> DataFrame:
    """Bilinear resampling at (y + dy, x + dx), 0 outside."""
    iy, ix = int(dy // 1), int(dx // 1)
    fy, fx = dy - iy, dx - ix
    weights = [(0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)]
    return each(planes, lambda y, x: F.round(sum((at(y + iy + a, x + ix + b) * w for a, b, w in weights), F.lit(0.0)), 6))


def window(kind: str, n: int) -> list[float]:
    """A smoothing window's weights, of sum 1. kind: flat, hanning, hamming, bartlett, blackman."""
    turn = [2 * math.pi * i / (n - 1) for i in range(n)]
    made = {
        "flat": [1.0] * n,
        "hanning": [0.5 - 0.5 * math.cos(t) for t in turn],
        "hamming": [0.54 - 0.46 * math.cos(t) for t in turn],
        "bartlett": [1 - abs(2 * i / (n - 1) - 1) for i in range(n)],
        "blackman": [0.42 - 0.5 * math.cos(t) + 0.08 * math.cos(2 * t) for t in turn],
    }[kind]
    return [w / sum(made) for w in made]


def smoothed(planes: DataFrame, n: int = 3, kind: str = "flat") -> DataFrame:
    """Rows convolved with a window of n weights. Both ends are continued by point reflection: k pixels before the first
    value x[0] stands 2 x[0] - x[k + 1], k pixels after the last one 2 x[-1] - x[-k]. Rows shorter than the window stay out."""
    weights, nx = window(kind, n), F.col("nx")

    def value(y: Column, x: Column) -> Column:
        inside = at(y, x)
        before = 2 * at(y, F.lit(0)) - at(y, 1 - x)
        after = 2 * at(y, nx - 1) - at(y, 2 * nx - 1 - x)
        return F.when(x < 0, before).when(x >= nx, after).otherwise(inside)

    place = [(n - 1) // 2 - j for j in range(n)]
    return each(planes.where(F.col("nx") >= n), lambda y, x: F.round(sum((value(y, x + d) * w for d, w in zip(place, weights)), F.lit(0.0)), 6))


def derivative(planes: DataFrame) -> DataFrame:
    """First difference along x; the first column is 0."""
    return each(planes, lambda y, x: F.round(F.when(x > 0, at(y, x) - at(y, x - 1)).otherwise(0.0), 6))


def fit_line(pixels: DataFrame, *keys: str) -> DataFrame:
    """Least-squares line of v over x."""
    slope = F.try_divide(F.covar_pop("x", "v"), F.var_pop("x"))
    return pixels.groupBy(*keys).agg(F.round(slope, 6).alias("slope"), F.round(F.avg("v") - slope * F.avg("x"), 6).alias("intercept"))


def close_pairs(pixels: DataFrame, least: float, distance: float = 2.414, cell: int = 3) -> DataFrame:
    """Pairs of bright pixels of a plane within a distance: each pixel is put into its cell and looked up from the cells around it, so the join is on equal keys."""
    bright = pixels.where(F.col("v") >= least).select("z", "w", "y", "x", F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = bright.withColumn("s", F.explode(steps)).select("z", "w", F.col("y").alias("y2"), F.col("x").alias("x2"), (F.col("cy") + F.col("s.i")).alias("cy"), (F.col("cx") + F.col("s.j")).alias("cx"))
    later = (F.col("y2") > F.col("y")) | ((F.col("y2") == F.col("y")) & (F.col("x2") > F.col("x")))
    close = (F.col("y2") - F.col("y")) ** 2 + (F.col("x2") - F.col("x")) ** 2 <= distance**2
    return bright.join(near, ["z", "w", "cy", "cx"]).where(later & close).groupBy("z", "w").agg(F.count("*").alias("n_pairs"))


def _mapped(planes: DataFrame, value, whole: Column | None = None) -> DataFrame:
    """Planes of value(v, w), where w is a value of the whole plane: bound as a variable, so it is found once and not for every pixel."""
    made = F.get(F.transform(F.array(whole if whole is not None else F.lit(0)), lambda w: F.transform("data", lambda v: F.round(value(v, w), 6))), F.lit(0))
    return planes.select("z", "w", "ny", "nx", made.alias("data"))


def _ends() -> Column:
    return F.struct(F.array_min("data").alias("lo"), F.array_max("data").alias("hi"))


def inverted(planes: DataFrame) -> DataFrame:
    """The plane's maximum less each value."""
    return _mapped(planes, lambda v, top: top - v, F.array_max("data"))


def logarithm(planes: DataFrame) -> DataFrame:
    """Natural logarithms, not below 0; null for values below 0."""
    return _mapped(planes, lambda v, _: F.when(v == 0, 0.0).when(v > 0, F.greatest(F.ln(v), F.lit(0.0))))


def normalised(planes: DataFrame, by: str = "range") -> DataFrame:
    """Values from 0 to 1 ('range'), or with mean 0 and deviation 1 ('deviation'). Null in a constant plane."""
    if by == "range":
        return _mapped(planes, lambda v, e: F.try_divide(v - e["lo"], e["hi"] - e["lo"]), _ends())
    shared = F.struct(moments(F.col("data")).alias("m"), F.get("data", F.lit(0)).alias("first"))

    def value(v, e):
        mean = e["m"]["s"] / e["m"]["n"]
        return F.try_divide(v - e["first"] - mean, F.sqrt(F.greatest(e["m"]["q"] / e["m"]["n"] - mean * mean, F.lit(0.0))))

    return _mapped(planes, value, shared)


def stretched(planes: DataFrame, most: float) -> DataFrame:
    """Values less the plane's minimum, times most / maximum. Null where the maximum is 0."""
    return _mapped(planes, lambda v, e: F.try_divide(F.lit(float(most)), e["hi"]) * (v - e["lo"]), _ends())


def thresholded(planes: DataFrame, least: float, from_zero: bool = False) -> DataFrame:
    """Values above `least`, others as `least`; or both less `least`."""
    return _mapped(planes, lambda v, _: F.when(v > least, v - (least if from_zero else 0.0)).otherwise(0.0 if from_zero else least))


def clipped(planes: DataFrame, least: float, most: float) -> DataFrame:
    return _mapped(planes, lambda v, _: F.least(F.greatest(v, F.lit(float(least))), F.lit(float(most))))


def turned(planes: DataFrame, quarters: int) -> DataFrame:
    """Rotated by quarter turns: 1 counter-clockwise, 2 upside down, 3 or -1 clockwise."""
    ny, nx = F.col("ny"), F.col("nx")
    if quarters % 4 == 2:
        return each(planes, lambda y, x: at(ny - 1 - y, nx - 1 - x))
    if quarters % 4 == 1:
        return each(planes, lambda y, x: at(x, nx - 1 - y), nx, ny)
    if quarters % 4 == 3:
        return each(planes, lambda y, x: at(ny - 1 - x, y), nx, ny)
    return planes


def mirrored(planes: DataFrame, axis: str) -> DataFrame:
    ny, nx = F.col("ny"), F.col("nx")
    return each(planes, lambda y, x: at(ny - 1 - y if "y" in axis else y, nx - 1 - x if "x" in axis else x))


def fitted_to(planes: DataFrame, ny: int, nx: int, pad: float = 0.0) -> DataFrame:
    """The plane in the middle of one of another size: padded where that is larger, cut where it is smaller."""

    def before(size: Column, wanted: int) -> Column:
        more = F.lit(wanted) - size  # halves are rounded down when it grows and up when it shrinks
        return F.when(more > 0, F.floor(more / 2)).otherwise(F.ceil(more / 2)).cast("int")

    by, bx = before(F.col("ny"), ny), before(F.col("nx"), nx)
    inside = lambda i, b, n: (i - b >= 0) & (i - b < n)
    value = lambda y, x: F.when(inside(y, by, F.col("ny")) & inside(x, bx, F.col("nx")), at(y - by, x - bx)).otherwise(float(pad))
    return each(planes, value, F.lit(ny), F.lit(nx))


def without_border(planes: DataFrame, border: int) -> DataFrame:
    return each(planes.where((F.col("ny") > 2 * border) & (F.col("nx") > 2 * border)), lambda y, x: at(y + border, x + border), F.col("ny") - 2 * border, F.col("nx") - 2 * border)


def edge_masked(planes: DataFrame, value: float | None = None) -> DataFrame:
    """The last two rows and the first two columns set to a value, or to the median of the others."""
    inside = lambda i: (F.floor(i / F.col("nx")) < F.col("ny") - 2) & (i % F.col("nx") >= 2)
    ordered = F.array_sort(F.filter("data", lambda v, i: inside(i)))
    n = F.size(ordered)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    edge = lambda y, x: (y >= F.col("ny") - 2) | (x < 2)
    if value is None:
        return each(planes, lambda y, x, m: F.when(edge(y, x), m).otherwise(at(y, x)), whole=middle)
    return each(planes, lambda y, x: F.when(edge(y, x), float(value)).otherwise(at(y, x)))


def region_masked(planes: DataFrame, y: float, x: float, radius: float, value: float = 0.0) -> DataFrame:
    """About 2 radius + 1 pixels round a place set to a value."""
    (y0, y1), (x0, x1) = (nearby(F.col(n), F.lit(float(p)), 2 * radius + 1) for n, p in (("ny", y), ("nx", x)))
    return each(planes, lambda j, i: F.when((j >= y0) & (j < y1) & (i >= x0) & (i < x1), float(value)).otherwise(at(j, i)))


def squared_gradient(planes: DataFrame) -> DataFrame:
    """Sum of the squared differences along y and x: central ones, one-sided at the edges."""
    ny, nx = F.col("ny"), F.col("nx")

    def slope(low: Column, high: Column, at_low: Column, at_high: Column) -> Column:
        return (at_high - at_low) / F.greatest(high - low, F.lit(1))

    def value(y: Column, x: Column) -> Column:
        y0, y1 = F.greatest(y - 1, F.lit(0)), F.least(y + 1, ny - 1)
        x0, x1 = F.greatest(x - 1, F.lit(0)), F.least(x + 1, nx - 1)
        dy, dx = slope(y0, y1, at(y0, x), at(y1, x)), slope(x0, x1, at(y, x0), at(y, x1))
        return F.round(dy * dy + dx * dx, 6)

    return each(planes, value)


def saturated(planes: DataFrame, most: float) -> DataFrame:
    """(w, saturated): pixels of each channel that have the greatest value of their type. A plane adds its own number."""
    return planes.groupBy("w").agg(F.sum(F.size(F.filter("data", lambda v: v >= most))).alias("saturated"))


def apodised(planes: DataFrame, width: int) -> DataFrame:
    """Edges softened towards the plane's median over `width` pixels, in equal steps."""
    ny, nx = F.col("ny"), F.col("nx")
    ordered = F.array_sort("data")
    half = F.size("data") / 2
    middle = (F.get(ordered, F.ceil(half - 1).cast("int")) + F.get(ordered, F.floor(half).cast("int"))) / 2

    def value(y: Column, x: Column, whole: Column) -> Column:
        depth = F.least(y, x, ny - 1 - y, nx - 1 - x)
        share = F.least(depth, F.lit(width)) / width
        return F.round(at(y, x) * share + whole * (1 - share), 6)

    return each(planes, value, whole=middle)
