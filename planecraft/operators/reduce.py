"""Reductions over stacks. All are partial aggregates: only one row for each group and task is shuffled.

Quantiles are exact, by a sketch and counts: a sketch for each group and task is shuffled, and the
different values next to the wanted ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planecraft.plans.storage import checked, stored


def mmms(pixels: DataFrame, *keys: str) -> DataFrame:
    """Minimum, maximum, mean and population standard deviation."""
    return pixels.groupBy(*keys).agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.round(F.avg("v"), 6).alias("v_mean"), F.round(F.stddev_pop("v"), 6).alias("v_std"))


def moments(data: Column) -> Column:
    """n, sum, sum of squares about the first value, and that value, of an array in one pass: all that mean and deviation need."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    first = F.get(data, F.lit(0))
    step = lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["s"] + (v - first)).alias("s"), (a["q"] + (v - first) * (v - first)).alias("q"))
    return F.aggregate(data, zero, step)


def section_mmms(sections: DataFrame) -> DataFrame:
    """The same for each plane, inside its row: no shuffle, and one pass of its pixels."""
    rows = sections.where(F.size("data") > 0).select("z", "w", F.array_min("data").alias("v_min"), F.array_max("data").alias("v_max"), F.get("data", F.lit(0)).alias("first"), moments(F.col("data")).alias("m"))
    mean = F.col("m.s") / F.col("m.n")
    return rows.select("z", "w", "v_min", "v_max", F.round(F.col("first") + mean, 6).alias("v_mean"), F.round(F.sqrt(F.greatest(F.col("m.q") / F.col("m.n") - mean * mean, F.lit(0.0))), 6).alias("v_std"))


def _narrowed(values: DataFrame, wanted: DataFrame, by: list[str], bins: int = 256) -> tuple[DataFrame, DataFrame, int]:
    """Of counted values (by, v, n) those of the bins that hold the wanted ranks, the ranks inside these, and the most values of a bin.

    Bins lie between approximate quantiles, which set their size only: they are counted exactly.
    """
    edges = checked(values.groupBy(*by).agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], 10 * bins).alias("edges")), "edges")
    binned = values.join(edges, by).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    counts = binned.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.count("*").alias("values"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))).join(wanted, by)
    hit = upto.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    hit = stored(hit.select(*by, "bin", "values", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "ranks")
    kept = stored(binned.join(hit.select(*by, "bin"), [*by, "bin"]).drop("bin"), "values")
    return kept, hit.select(*by, "rank"), hit.agg(F.max("values").alias("values")).first()["values"] or 0


def ranked(pixels: DataFrame, ranks: dict[str, tuple[float, Column]], *keys: str, accuracy: int = 20_000, most: int = 1_000_000) -> DataFrame:
    """(keys, one column for each of `ranks`): exact values at ranks (from 0) among a group's values. ranks: the share of the
    values below, about, and the rank over the group's count `n`.

    One pass takes a sketch, whose bounded error says between which two values a rank lies; one more counts the values below
    these and each value between them, some 4 / accuracy of the group. Only if these are more than `most` are they narrowed again.
    """
    keyed = pixels.select(F.struct(*keys).alias("key"), "v")  # a struct is joined by its nulls too
    known = keyed.where(F.col("v").isNotNull())
    shares = sorted({share for share, _ in ranks.values()})
    apart = 2 / accuracy
    ends = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-apart, apart)]
    sketch = checked(known.groupBy("key").agg(F.count("*").alias("n"), F.percentile_approx("v", ends, accuracy).alias("ends")), "sketch")
    spans = F.array(*[F.struct(F.lit(i).alias("share"), F.get("ends", F.lit(2 * i)).alias("low"), F.get("ends", F.lit(2 * i + 1)).alias("high")) for i in range(len(shares))])
    # below the first end all values are one; above the second none count
    upto = F.filter(spans, lambda s: F.col("v") <= s["high"])
    placed = known.join(sketch, "key").select("key", "v", F.explode(upto).alias("s"))
    inside = F.when(F.col("v") >= F.col("s.low"), F.col("v"))
    counts = stored(placed.groupBy("key", F.col("s.share").alias("share"), inside.alias("v")).agg(F.count("*").alias("n")), "counts")
    below = counts.where("v IS NULL").select("key", "share", F.col("n").alias("below"))
    index = {s: i for i, s in enumerate(shares)}
    each = F.array(*[F.struct(F.lit(name).alias("which"), F.lit(index[share]).alias("share"), rank.cast("long").alias("rank")) for name, (share, rank) in ranks.items()])
    wanted = sketch.select("key", F.explode(each).alias("r")).select("key", "r.*").join(below, ["key", "share"], "left")
    wanted = stored(wanted.select("key", "which", "share", (F.col("rank") - F.coalesce("below", F.lit(0))).alias("rank")), "ranks")
    held = counts.where("v IS NOT NULL")
    sizes = held.groupBy("key", "share").agg(F.sum("n").alias("held"), F.count("*").alias("values"))
    worst = sizes.agg(F.max("values").alias("values")).first()["values"] or 0
    missed = wanted.join(sizes, ["key", "share"], "left").where("rank < 0 OR rank >= coalesce(held, 0)")
    if not missed.isEmpty():  # the sketch was wrong by more than it states
        return ranked(pixels, ranks, *keys, accuracy=max(accuracy // 10, 4), most=most)
    values, by = held.join(wanted.select("key", "share", "which"), ["key", "share"]).select("key", "which", "v", "n"), ["key", "which"]
    wanted = wanted.select("key", "which", "rank")
    while worst > most:
        values, wanted, worst = _narrowed(values, wanted, by)
    upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("v"))).join(wanted, by)
    hit = upto.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    found = hit.groupBy("key").agg(*[F.max(F.when(F.col("which") == name, F.col("v"))).alias(name) for name in ranks])
    return keyed.select("key").distinct().join(found, "key", "left").select("key.*", *ranks)


def median(pixels: DataFrame, name: str, *keys: str) -> DataFrame:
    """Mean of the two middle values."""
    middle = ranked(pixels, {"low": (0.5, F.floor((F.col("n") - 1) / 2)), "high": (0.5, F.floor(F.col("n") / 2))}, *keys)
    return middle.select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias(name))


def median_mad(pixels: DataFrame, *keys: str) -> DataFrame:
    """Median, and median absolute deviation from it."""
    centre = checked(median(pixels, "v_median", *keys), "medians")
    apart = pixels.join(centre, list(keys)).select(*keys, F.abs(F.col("v") - F.col("v_median")).alias("v"))
    both = centre.join(median(apart, "v_mad", *keys), list(keys))
    return both.select(*keys, F.round("v_median", 6).alias("v_median"), F.round("v_mad", 6).alias("v_mad"))


def percentile(pixels: DataFrame, share: float, *keys: str) -> DataFrame:
    """The least value that `share` of the values don't exceed."""
    return ranked(pixels, {"v_top": (share, F.greatest(F.ceil(F.col("n") * share) - 1, F.lit(0)))}, *keys)


def argmax(pixels: DataFrame, *keys: str) -> DataFrame:
    """Place of the maximum; of equal values the first in z, y, x order."""
    best = F.max_by(F.struct("v", "z", "y", "x"), F.struct("v", -F.col("z"), -F.col("y"), -F.col("x"))).alias("b")
    return pixels.groupBy(*keys).agg(best).select(*keys, "b.v", "b.z", "b.y", "b.x")


def projection(pixels: DataFrame, *keys: str) -> DataFrame:
    """Maximum along z."""
    return pixels.groupBy(*keys, "y", "x").agg(F.max("v").alias("v"))


def best(pixels: DataFrame, key: str, value: str = "v") -> DataFrame:
    """The key with the highest mean, the first of equal ones: reference channel or time frame."""
    means = pixels.groupBy(key).agg(F.avg(value).alias("m"))
    return means.orderBy(F.desc("m"), key).limit(1).select(key, F.round("m", 6).alias("v_mean"))


def pearson(planes: DataFrame, reference: int) -> DataFrame:
    """Correlation of each channel's voxels with those of the reference channel; null where one is constant.

    Planes meet by z; a plane adds its sums, so no pixel is shuffled.
    """
    ref = planes.where(F.col("w") == reference).select("z", F.col("data").alias("ref"))
    pairs = F.zip_with("data", "ref", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("a", "b", "aa", "bb", "ab")])
    add = lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["b"] + p["b"]).alias("b"), (s["aa"] + p["a"] * p["a"]).alias("aa"), (s["bb"] + p["b"] * p["b"]).alias("bb"), (s["ab"] + p["a"] * p["b"]).alias("ab"))
    sums = planes.join(ref, "z").select("w", F.size("data").alias("n"), F.aggregate(pairs, zero, add).alias("s"))
    total = sums.groupBy("w").agg(F.sum("n").alias("n"), *[F.sum(f"s.{c}").alias(c) for c in ("a", "b", "aa", "bb", "ab")])
    cov, va, vb = (F.col(x + y) / F.col("n") - F.col(x) * F.col(y) / (F.col("n") * F.col("n")) for x, y in ("ab", "aa", "bb"))
    # what is left of a constant channel by rounding is no spread
    spread = F.when((va > 1e-12) & (vb > 1e-12), F.sqrt(va * vb))
    return total.select("w", F.round(F.try_divide(cov, spread), 6).alias("pearson"))


def centroid(pixels: DataFrame, *keys: str) -> DataFrame:
    """Centre of mass with weights v + 1."""
    m = F.col("v") + 1
    return pixels.groupBy(*keys).agg(F.round(F.sum(m * F.col("y")) / F.sum(m), 6).alias("cy"), F.round(F.sum(m * F.col("x")) / F.sum(m), 6).alias("cx"))


def radial_average(pixels: DataFrame, cy: float, cx: float, *keys: str) -> DataFrame:
    """Mean by whole distance from a centre."""
    r = F.floor(F.sqrt((F.col("y") - cy) ** 2 + (F.col("x") - cx) ** 2))
    return pixels.groupBy(*keys, r.alias("r")).agg(F.round(F.avg("v"), 6).alias("v_mean"), F.count("*").alias("n"))


def z_profile(pixels: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Mean of a box for each z; the box is a filter below the aggregate."""
    return pixels.where(F.col("y").between(*y) & F.col("x").between(*x)).groupBy("w", "z").agg(F.round(F.avg("v"), 6).alias("v_mean"))


def line_profile(planes: DataFrame, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """Value of the nearest pixel at each unit step from `start` (y, x), short of `end`; null outside the plane."""
    dy, dx = end[0] - start[0], end[1] - start[1]
    length = (dy * dy + dx * dx) ** 0.5
    steps = F.sequence(F.lit(0).cast("long"), F.lit(max(math.ceil(length) - 1, 0)).cast("long"))
    at = planes.select("z", "w", "ny", "nx", "data", F.explode(steps).alias("step"))
    y, x = (F.floor(F.lit(float(a)) + F.col("step") * F.lit(d / (length or 1)) + 0.5) for a, d in ((start[0], dy), (start[1], dx)))
    inside = y.between(0, F.col("ny") - 1) & x.between(0, F.col("nx") - 1)
    return at.select("z", "w", "step", F.when(inside, F.get("data", (y * F.col("nx") + x).cast("int"))).alias("v"))


def pearson_in_common(pixels: DataFrame, margin: int = 2) -> DataFrame:
    """(image, pearson): correlation of channels 0 and 1 over the box that all images cover, half the margin less at each side.

    pixels: (image, w, z, y, x, v), whose places are absolute. Null where a channel is constant there.
    """
    spans = pixels.groupBy("image").agg(*[f(c).alias(f"{c}{k}") for c in "zyx" for k, f in ((0, F.min), (1, F.max))])
    box = spans.agg(*[f.alias(f"{c}{k}") for c in "zyx" for k, f in ((0, F.max(f"{c}0") + margin // 2), (1, F.min(f"{c}1") - margin // 2))])
    inside = pixels.where("w in (0, 1)").join(F.broadcast(box), on=[F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1")) for c in "zyx"])  # one row
    one = lambda w: F.max(F.when(F.col("w") == w, F.col("v")))
    both = inside.groupBy("image", "z", "y", "x").agg(one(0).alias("a"), one(1).alias("b")).where("a is not null and b is not null")
    spread = F.sqrt(F.var_pop("a") * F.var_pop("b"))
    return both.groupBy("image").agg(F.round(F.try_divide(F.covar_pop("a", "b"), spread), 6).alias("pearson"))
