"""Beads seen in several channels: those that stand alone, how far channels differ, and the report of that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alone(beads: DataFrame, distance: float) -> DataFrame:
    """Beads (image, bead, y, x) that have no other bead of their image within the distance.

    Two beads of one cell are always that near, so a cell with several keeps none and gives no pairs. A bead that is
    alone in its cell is held against the cells around: a cell meets at most 24 such beads, however full it is.
    """
    side = distance / 2**0.5 * (1 - 1e-9)
    placed = beads.withColumn("cy", F.floor(F.col("y") / side)).withColumn("cx", F.floor(F.col("x") / side))
    single = placed.groupBy("image", "cy", "cx").agg(F.count("*").alias("n"), F.min("bead").alias("bead"), F.min("y").alias("y"), F.min("x").alias("x")).where("n = 1").drop("n")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i or j])
    wanted = single.withColumn("o", F.explode(around)).select("image", "bead", F.col("y").alias("y0"), F.col("x").alias("x0"), (F.col("cy") + F.col("o.i")).alias("cy"), (F.col("cx") + F.col("o.j")).alias("cx"))
    others = wanted.join(placed.select("image", "cy", "cx", "y", "x"), ["image", "cy", "cx"])
    near = others.where((F.col("y") - F.col("y0")) ** 2 + (F.col("x") - F.col("x0")) ** 2 < distance * distance).select("image", "bead").distinct()
    return single.select("image", "bead", "y", "x").join(near, ["image", "bead"], "left_anti")


def deviations(found: DataFrame, reference: int, pixel: tuple[float, float], most: float) -> DataFrame:
    """(image, bead, w, y, x, dy, dx) of all other channels: the reference's place and the way from it, as lengths.

    found: (image, bead, w, y, x) in pixels, one row for each bead and channel. A bead goes as a whole if it lacks the
    reference, or if a channel is further off than `most` along an axis, or not off at all (not fitted).
    """
    seen = found.groupBy("image", "bead").agg(F.collect_list(F.struct("w", "y", "x")).alias("all"))  # as many as channels
    own = F.get(F.filter("all", lambda s: s["w"] == reference), F.lit(0))
    far = lambda s: F.struct(s["w"].alias("w"), ((s["y"] - F.col("own.y")) * pixel[0]).alias("dy"), ((s["x"] - F.col("own.x")) * pixel[1]).alias("dx"))
    rest = seen.withColumn("own", own).where("own is not null").withColumn("off", F.transform(F.filter("all", lambda s: s["w"] != reference), far))
    bad = F.exists("off", lambda s: (F.greatest(F.abs(s["dy"]), F.abs(s["dx"])) > most) | ((s["dy"] == 0) & (s["dx"] == 0)))
    rows = rest.where(~bad).select("image", "bead", (F.col("own.y") * pixel[0]).alias("y"), (F.col("own.x") * pixel[1]).alias("x"), F.explode("off").alias("s"))
    return rows.select("image", "bead", "s.w", "y", "x", "s.dy", "s.dx")


def report(off: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """For each channel of `deviations`: mean and deviation of dy, dx and of the distance, how |dy| and |dx| go with the way from the centre, and the beads counted."""
    values = {"dy": F.col("dy"), "dx": F.col("dx"), "distance": F.sqrt(F.col("dy") ** 2 + F.col("dx") ** 2)}
    sums = [F.round(f(v), 6).alias(f"{n}_{k}") for n, v in values.items() for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    away = {c: F.abs(F.col(c) - m) for c, m in zip("yx", centre)}
    spread = lambda a, b: F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    return off.groupBy("w").agg(*sums, *[F.round(spread(away[c], F.abs(F.col(f"d{c}"))), 6).alias(f"pearson_{c}") for c in "yx"], F.count("*").alias("n"))
