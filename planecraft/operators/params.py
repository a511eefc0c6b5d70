"""Algebra of alignment parameters: rows (t, w, tz, ty, tx, r, mz, my, mx)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.plans.storage import checked

SHIFTS, ZOOMS = ("tz", "ty", "tx", "r"), ("mz", "my", "mx")
NAMES = SHIFTS + ZOOMS


def rebased(params: DataFrame, reference: int) -> DataFrame:
    """Relative to the reference channel of the same frame: shifts subtract, zooms divide. One row of each frame is the build side."""
    ref = params.where(F.col("w") == reference).select("t", *[F.col(c).alias(f"ref_{c}") for c in NAMES])
    both = params.join(ref, "t")
    return both.select("t", "w", *[F.round(F.col(c) - F.col(f"ref_{c}"), 6).alias(c) for c in SHIFTS], *[F.round(F.col(c) / F.col(f"ref_{c}"), 6).alias(c) for c in ZOOMS])


def inverted(params: DataFrame) -> DataFrame:
    return params.select("t", "w", *[F.round(-F.col(c), 6).alias(c) for c in SHIFTS], *[F.round(1 / F.col(c), 6).alias(c) for c in ZOOMS])


def averaged(params: DataFrame, reference: int) -> DataFrame:
    """Mean of each channel's parameters over all frames, after rebasing."""
    return rebased(params, reference).groupBy("w").agg(*[F.round(F.avg(c), 4).alias(c) for c in NAMES])


def composed(one: DataFrame, two: DataFrame) -> DataFrame:
    """One alignment after another: shifts add, zooms multiply."""
    b = two.select("t", "w", *[F.col(c).alias(f"b_{c}") for c in NAMES])
    return one.join(b, ["t", "w"]).select("t", "w", *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in SHIFTS], *[(F.col(c) * F.col(f"b_{c}")).alias(c) for c in ZOOMS])


def in_nanometres(params: DataFrame, pixel: tuple[float, float, float], half: tuple[float, float, float]) -> DataFrame:
    """Every parameter as a length at the image's half size, and the root of their squares' sum. pixel: micrometres in z, y, x."""
    nm = [p * 1000 for p in pixel]
    radius, across = (half[1] ** 2 + half[2] ** 2) ** 0.5, (nm[1] + nm[2]) / 2
    sizes = {c: F.col(c) * n for c, n in zip(("tz", "ty", "tx"), nm)}
    sizes["r"] = 2 * F.sin(F.radians(F.abs(F.col("r"))) / 2) * radius * across
    sizes |= {c: F.abs(F.col(c) * h - h) * n for c, h, n in zip(ZOOMS, half, nm)}
    total = F.sqrt(sum((e * e for e in sizes.values()), F.lit(0.0)))
    return params.select("t", "w", *[F.round(e, 4).alias(c) for c, e in sizes.items()], F.round(total, 4).alias("total"))


def matched(targets: DataFrame, params: DataFrame, reference: float) -> DataFrame:
    """Parameters of each target wavelength in every frame, by its rounded value; a wavelength without any takes the frame's reference.

    Of channels of one wavelength the first counts. The targets are a row for each channel.
    """
    first = F.min_by(F.struct(*NAMES), "w").alias("p")
    own = params.groupBy("t", F.round("wave").cast("int").alias("k")).agg(first)
    ref = own.where(F.col("k") == int(round(reference))).select("t", F.col("p").alias("ref"))
    wanted = params.select("t").distinct().join(F.broadcast(targets.withColumn("k", F.round("wave").cast("int"))))
    found = wanted.join(own, ["t", "k"], "left").join(ref, "t", "left")
    return found.select("t", "target", "wave", *[F.coalesce(f"p.{c}", f"ref.{c}").alias(c) for c in NAMES])


def crop_box(params: DataFrame, ny: int, nx: int) -> DataFrame:
    """The box of each frame that all channels cover: the largest start and the least end."""
    lo = lambda c: F.ceil(F.greatest(F.col(c), F.lit(0.0)))
    hi = lambda c, n: F.floor(n + F.least(F.col(c), F.lit(0.0)))
    return params.groupBy("t").agg(F.max(lo("ty")).alias("y0"), F.min(hi("ty", ny)).alias("y1"), F.max(lo("tx")).alias("x0"), F.min(hi("tx", nx)).alias("x1"))


def flat_gain(pixels: DataFrame) -> DataFrame:
    """Gain of each channel's pixel: the channel's mean over the pixel's mean, of v + 1."""
    spots = pixels.groupBy("w", "y", "x").agg(F.avg(F.col("v") + 1).alias("spot"))
    means = spots.groupBy("w").agg(F.avg("spot").alias("m"))
    return spots.join(means, "w").select("w", "y", "x", F.round(F.try_divide("m", "spot"), 6).alias("gain"))


def flat_applied(pixels: DataFrame, gain: DataFrame) -> DataFrame:
    """Values times the gain of their channel and place; without one they stay. The gain has a row for each channel and place, whatever the stack."""
    return pixels.join(checked(gain, "gain", 1_000_000), ["w", "y", "x"], "left").groupBy("z", "w").agg(F.round(F.sum((F.col("v") + 1) * F.coalesce("gain", F.lit(1.0))), 4).alias("total"))


def neighbours(params: DataFrame, edges: DataFrame, pixel: tuple[float, float, float], centre: tuple[float, float, float]) -> DataFrame:
    """How each well's neighbours differ from it, as lengths: (t, src, dst, tz ... mx, total). edges: (src, dst), a few rows.

    The neighbour's parameters minus the well's; shifts times the pixel, the rotation as the way of the image's
    centre about the origin, and zooms (as 1 + difference) as the way of the centre. pixel: lengths in z, y, x.
    """
    a, b = params.alias("a"), params.alias("b")
    joined = edges.join(a, F.col("src") == F.col("a.w")).join(b, (F.col("dst") == F.col("b.w")) & (F.col("a.t") == F.col("b.t")))
    apart = {c: F.col(f"b.{c}") - F.col(f"a.{c}") for c in NAMES}
    sizes = {c: apart[c] * n for c, n in zip(("tz", "ty", "tx"), pixel)}
    sizes["r"] = 2 * F.sin(F.radians(F.abs(apart["r"])) / 2) * ((centre[1] ** 2 + centre[2] ** 2) ** 0.5 * (pixel[1] + pixel[2]) / 2)
    sizes |= {c: F.abs(apart[c] * h) * n for c, h, n in zip(ZOOMS, centre, pixel)}
    total = F.sqrt(sum((e * e for e in sizes.values()), F.lit(0.0)))
    return joined.select(F.col("a.t").alias("t"), "src", "dst", *[F.round(e, 4).alias(c) for c, e in sizes.items()], F.round(total, 4).alias("total"))
