"""Measures of stacks and of labelled regions: partial aggregates, with group statistics joined as checked small tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planecraft.plans.storage import checked

#: Full width at half maximum of a Gaussian, in standard deviations.
HALF_WIDTH = 2 * math.sqrt(2 * math.log(2))


def norms(pixels: DataFrame, *keys: str) -> DataFrame:
    """Sum of magnitudes, Euclidean length, and root of the mean square."""
    square = F.col("v") * F.col("v")
    return pixels.groupBy(*keys).agg(F.round(F.sum(F.abs("v")), 6).alias("l1"), F.round(F.sqrt(F.sum(square)), 6).alias("l2"), F.round(F.sqrt(F.avg(square)), 6).alias("rms"))


def half_width(pixels: DataFrame, *keys: str) -> DataFrame:
    """Full width at half maximum of Gaussian values."""
    return pixels.groupBy(*keys).agg(F.round(F.stddev_pop("v") * HALF_WIDTH, 6).alias("fwhm"))


def noise(pixels: DataFrame, *keys: str) -> DataFrame:
    """Noise from the values below the mean, and how far the maximum stands above the mean in units of it."""
    means = checked(pixels.groupBy(*keys).agg(F.avg("v").alias("m"), F.max("v").alias("top")), "means")
    below = pixels.join(means, list(keys)).groupBy(*keys).agg(F.first("m").alias("m"), F.first("top").alias("top"), F.avg(F.when(F.col("v") < F.col("m"), F.col("v"))).alias("low"))
    sigma = F.abs(F.col("low") - F.col("m")) * math.sqrt(math.pi / 2)
    return below.select(*keys, F.round(sigma, 6).alias("noise_sigma"), F.round(F.try_divide(F.col("top") - F.col("m"), sigma), 6).alias("signal_to_noise"))


def argmin(pixels: DataFrame, *keys: str) -> DataFrame:
    """Place of the minimum; of equal values the first in z, y, x order."""
    best = F.min(F.struct("v", "z", "y", "x")).alias("b")
    return pixels.groupBy(*keys).agg(best).select(*keys, "b.v", "b.z", "b.y", "b.x")


def labelled(pixels: DataFrame, *keys: str) -> DataFrame:
    """Of pixels (label, y, x, v), for each label above 0: sum, mean, first places of the extremes, and centre of mass."""
    v = F.col("v")
    top = F.min(F.struct((-v).alias("n"), "z", "y", "x")).alias("top")
    low = F.min(F.struct("v", "z", "y", "x")).alias("low")
    mass = F.sum("v")
    rows = pixels.where("label > 0").groupBy(*keys, "label").agg(F.round(mass, 6).alias("total"), F.round(F.avg("v"), 6).alias("v_mean"), top, low, *[F.round(F.try_divide(F.sum(v * F.col(a)), mass), 6).alias(f"c{a}") for a in ("y", "x")])
    return rows.select(*keys, "label", "total", "v_mean", *[F.col(f"top.{a}").alias(f"max_{a}") for a in "zyx"], *[F.col(f"low.{a}").alias(f"min_{a}") for a in "zyx"], "cy", "cx")


def mode(pixels: DataFrame, *keys: str) -> DataFrame:
    """Lower edge of the fullest of as many bins as there are values, the highest of equal ones. Null without spread."""
    limits = checked(pixels.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")), "limits")
    width = (F.col("hi") - F.col("lo")) / F.col("n")
    place = F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.col("n") - 1)
    bins = pixels.join(limits, list(keys)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("held"), F.first("lo").alias("lo"), F.first(width).alias("width"))
    best = F.max(F.struct("held", "bin", "lo", "width")).alias("b")
    return bins.groupBy(*keys).agg(best).select(*keys, F.round(F.col("b.lo") + F.col("b.bin") * F.col("b.width"), 6).alias("mode"), F.col("b.held").alias("held"))


def histogram_places(hist: DataFrame, bins: int, *keys: str) -> DataFrame:
    """A histogram with its empty bins, each at its place between the least and the greatest value."""
    limits = hist.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    every = limits.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    place = F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / (bins - 1), 6)
    return every.join(hist.select(*keys, "bin", "n"), [*keys, "bin"], "left").select(*keys, "bin", place.alias("x"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def projection(pixels: DataFrame, along: str, *keys: str) -> DataFrame:
    """Maximum along an axis (z, y or x)."""
    kept = [a for a in ("z", "y", "x") if a != along]
    return pixels.groupBy(*keys, *kept).agg(F.max("v").alias("v"))


def line_fit(pixels: DataFrame, *keys: str) -> DataFrame:
    """Least-squares line of v over x, and the length of the rest over the number of values. Null where x doesn't vary."""
    slope = F.try_divide(F.covar_pop("x", "v"), F.var_pop("x"))
    rest = F.greatest(F.var_pop("v") - slope * F.covar_pop("x", "v"), F.lit(0.0))
    n = F.count("*")
    return pixels.groupBy(*keys).agg(F.round(slope, 6).alias("slope"), F.round(F.avg("v") - slope * F.avg("x"), 6).alias("intercept"), F.round(F.sqrt(rest * n) / n, 6).alias("rest"))


def parabola_fit(pixels: DataFrame, *keys: str) -> DataFrame:
    """Least squares of v by c0 + c1 x + c2 x**2, from sums about the mean of x."""
    centre = checked(pixels.groupBy(*keys).agg(F.avg("x").alias("m")), "centres")
    d = F.col("x") - F.col("m")
    s = pixels.join(centre, list(keys)).groupBy(*keys).agg(F.first("m").alias("m"), F.count("*").alias("n"), *[F.sum(F.pow(d, F.lit(float(i)))).alias(f"s{i}") for i in (2, 3, 4)], *[F.sum(F.pow(d, F.lit(float(i))) * F.col("v")).alias(f"t{i}") for i in (0, 1, 2)])
    # with the mean of x at 0: n a + s2 c = t0, s2 b + s3 c = t1, s2 a + s3 b + s4 c = t2
    c = F.try_divide(F.expr("t2 - s2 * t0 / n - s3 * t1 / s2"), F.expr("s4 - s2 * s2 / n - s3 * s3 / s2"))
    rows = s.where("s2 > 0").select(*keys, "m", c.alias("c"), "n", "s2", "s3", "t0", "t1")
    b, a = F.expr("(t1 - s3 * c) / s2"), F.expr("(t0 - s2 * c) / n")
    rows = rows.select(*keys, "m", "c", b.alias("b"), a.alias("a"))
    return rows.select(*keys, F.round(F.expr("a - b * m + c * m * m"), 6).alias("c0"), F.round(F.expr("b - 2 * c * m"), 6).alias("c1"), F.round("c", 6).alias("c2"))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def from_polar(size: Column, angle: Column) -> tuple[Column, Column]:
    """Real and imaginary part."""
    return size * F.cos(angle), size * F.sin(angle)


def peak_statistics(peaks: DataFrame, pixel: tuple[float, float], *keys: str) -> DataFrame:
    """Mean and deviation of fitted peaks' heights and full widths at half height in y and x, and their number.

    peaks: (height, sigma_y, sigma_x). A peak as wide in y as in x was not fitted and takes no part. pixel: lengths in y, x.
    """
    fitted = peaks.where("sigma_y != sigma_x")
    values = {"height": F.col("height")} | {f"width_{c}": F.col(f"sigma_{c}") * (n * 2 * math.sqrt(2 * math.log(2))) for c, n in zip("yx", pixel)}
    return fitted.groupBy(*keys).agg(*[F.round(f(v), 6).alias(f"{n}_{k}") for n, v in values.items() for k, f in (("mean", F.avg), ("std", F.stddev_pop))], F.count("*").alias("n"))
