"""Made stacks: a row for each pixel, from a range of numbers, so of any size and in as many tasks as wanted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, ny: int, nx: int) -> DataFrame:
    """(y, x) of a plane."""
    return spark.range(ny * nx).select(F.floor(F.col("id") / nx).alias("y"), (F.col("id") % nx).alias("x"))


def _offsets(ny: int, nx: int, origin: tuple[float, float] | None, wrap: bool) -> tuple[Column, Column]:
    cy, cx = origin if origin is not None else ((ny - 1) / 2, (nx - 1) / 2)
    found = []
    for name, c, n in (("y", cy, ny), ("x", cx, nx)):
        d = F.col(name) - float(c)
        found.append(F.when(d > n / 2, d - n).otherwise(d) if wrap else d)
    return tuple(found)


def radial(ny: int, nx: int, origin: tuple[float, float] | None = None, wrap: bool = False) -> Column:
    """Distance from the origin (the middle), if wanted round the plane's edges."""
    y, x = _offsets(ny, nx, origin, wrap)
    return F.sqrt(y * y + x * x)


def square_radial(ny: int, nx: int, origin: tuple[float, float] | None = None, wrap: bool = False) -> Column:
    """The greater of the distances along y and x."""
    return F.greatest(*map(F.abs, _offsets(ny, nx, origin, wrap)))


def direction(ny: int, nx: int, origin: tuple[float, float] | None = None) -> Column:
    y, x = _offsets(ny, nx, origin, False)
    return F.atan2(y, x)


def made(spark: SparkSession, ny: int, nx: int, **values: Column) -> DataFrame:
    """(y, x, ...): a plane for each of the values."""
    return grid(spark, ny, nx).select("y", "x", *[F.round(v.cast("double"), 6).alias(n) for n, v in values.items()])


def ramp(n: int, axis: str = "x", start: float | None = 0, stop: float | None = None) -> Column:
    """Values in equal steps along an axis of n pixels: from start to stop, by ones where one of them is missing."""
    if start is None:
        start = (0 if stop is None else stop) + n - 1
        stop = 0 if stop is None else stop
    elif stop is None:
        stop = start + n - 1
    return F.lit(float(start)) + F.col(axis) * (float(stop - start) / max(n - 1, 1))


def cross(ny: int, nx: int) -> Column:
    """A test image: the middle row and column."""
    return F.when((F.col("y") == ny // 2) | (F.col("x") == nx // 2), 1.0).otherwise(0.0)


def hexagonal(spark: SparkSession, ny: int, nx: int, d: float, value: float = 1.0) -> DataFrame:
    """(y, x, v): pixels nearest to the places of a hexagonal grid of spacing d."""
    rows, columns = int(ny / (math.sqrt(3) / 2 * d)), int(nx / d)
    places = spark.range(rows * columns).select(F.floor(F.col("id") / max(columns, 1)).alias("j"), (F.col("id") % max(columns, 1)).alias("i"))
    y = F.floor(F.col("j") * (math.sqrt(3) / 2 * d) + 0.5)
    x = F.floor(F.col("i") * float(d) + F.when(F.col("j") % 2 == 1, d / 2).otherwise(0.0) + 0.5)
    return places.select(y.alias("y"), x.alias("x"), F.lit(float(value)).alias("v")).where((F.col("y") < ny) & (F.col("x") < nx)).distinct()


def drawn_line(spark: SparkSession, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """(y, x, v): pixels in whole steps along the axis that grows most, and how often each is met."""
    dy, dx = end[0] - start[0], end[1] - start[1]
    most = max(dy, dx)
    steps = spark.range(int(most) + 1)
    y, x = (F.floor(F.lit(float(s)) + F.col("id") * (d / most if most else 0.0) + 0.5) for s, d in ((start[0], dy), (start[1], dx)))
    return steps.groupBy(y.alias("y"), x.alias("x")).agg(F.count("*").cast("double").alias("v"))


def noise(spark: SparkSession, ny: int, nx: int, deviation: float = 1.0, mean: float = 0.0, seed: int = 0) -> DataFrame:
    """(y, x, v): normal noise, the same for one seed."""
    return grid(spark, ny, nx).withColumn("v", F.randn(seed) * deviation + mean)


def poisson(planes: DataFrame, column: str = "v", seed: int = 0) -> DataFrame:
    """Values as means of Poisson counts, by inverting the distribution at a uniform number; 0 for values up to 0.

    The sum runs to mean + 12 deviations + 20, beyond which less than 1e-12 of the counts lie.
    """
    v = F.greatest(F.col(column), F.lit(0.0))
    top = F.ceil(v + 12 * F.sqrt(v) + 20).cast("int")
    zero = F.struct(F.exp(-v).alias("p"), F.exp(-v).alias("sum"), F.lit(0).alias("count"))
    step = lambda a, k: F.struct((a["p"] * v / k).alias("p"), (a["sum"] + a["p"] * v / k).alias("sum"), (a["count"] + F.when(a["sum"] < F.col("_u"), 1).otherwise(0)).alias("count"))
    rows = planes.withColumn("_u", F.rand(seed))
    return rows.withColumn(column, F.aggregate(F.sequence(F.lit(1), top), zero, step)["count"].cast("double")).drop("_u")


def zernike_term(number: int) -> tuple[int, int, bool]:
    """Order, turns and whether it is a sine, of the numbered polynomial: orders follow each other, turns fall, cosine before sine."""
    order = math.isqrt(number)
    step = number - order * order
    return order, order - step // 2, step % 2 == 1


def zernike(number: int, ny: int, nx: int, radius: float | None = None, crop: bool = True) -> Column:
    """A Zernike polynomial about the plane's middle; 0 beyond the radius (half the shorter side) if cropped."""
    order, turns, sine = zernike_term(number)
    scale = min(ny, nx) / 2 if radius is None else radius
    r, value = radial(ny, nx) / float(scale), F.lit(0.0)
    for s in range(order - turns + 1):
        ways = math.factorial(2 * order - turns - s) / (math.factorial(s) * math.factorial(order - s) * math.factorial(order - turns - s))
        value = value + F.lit((-1) ** s * ways) * F.pow(r, F.lit(float(2 * (order - s) - turns)))
    if turns:
        angle = direction(ny, nx) * turns
        value = value * (F.sin(angle) if sine else F.cos(angle))
    return F.when(r <= 1, value).otherwise(0.0) if crop else value


def neighbourhood(spark: SparkSession, connectivity: int) -> DataFrame:
    """(z, y, x, v): a structuring element of 3 x 3 x 3: places of the middle plane in at most `connectivity` steps; the outer planes are empty."""
    cube = spark.range(27).select(F.floor(F.col("id") / 9).alias("z"), F.floor(F.col("id") / 3 % 3).alias("y"), (F.col("id") % 3).alias("x"))
    return cube.select("z", "y", "x", ((F.col("z") == 1) & (F.abs(F.col("y") - 1) + F.abs(F.col("x") - 1) <= connectivity)).alias("v"))


def flat_disc(spark: SparkSession, ny: int = 5, nx: int = 5, radius: float = 2.5) -> DataFrame:
    """(z, y, x, v): a structuring element of three planes with a disc in the middle one."""
    plane = grid(spark, ny, nx).select("y", "x", (radial(ny, nx) <= radius).alias("inside"))
    return plane.select(F.explode(F.expr("sequence(0L, 2L)")).alias("z"), "y", "x", "inside").select("z", "y", "x", ((F.col("z") == 1) & F.col("inside")).alias("v"))
