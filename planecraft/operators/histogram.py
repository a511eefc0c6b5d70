"""Histograms and thresholds. A histogram is at most groups x bins rows, whatever the stack; what follows works on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planecraft.plans.storage import checked


def histogram(pixels: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Counts by bin of width (max - min) / (bins - 1), so the maximum is in the last bin. Empty bins give no row."""
    limits = checked(pixels.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "limits")
    place = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), (F.col("hi") - F.col("lo")) / (bins - 1))), F.lit(0))
    return pixels.join(limits, list(keys)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("weight"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def equalised(hist: DataFrame, *keys: str) -> DataFrame:
    """Cumulative share of each bin."""
    w = Window.partitionBy(*keys)
    return hist.select(*keys, "bin", "n", (F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).alias("share"))


def otsu(hist: DataFrame, *keys: str) -> DataFrame:
    """The bin up to which values are background: it makes the variance between the classes largest, the first of equal ones."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("bin")
    parts = hist.select(*keys, "bin", F.sum("n").over(up).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(up).alias("s0"), F.sum("n").over(w).alias("nt"), F.sum(F.col("n") * F.col("bin")).over(w).alias("st"))
    n1 = F.col("nt") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - F.try_divide(F.col("st") - F.col("s0"), n1)
    scored = parts.where(n1 > 0).withColumn("between", F.round(F.col("n0") * n1 / (F.col("nt") * F.col("nt")) * apart * apart, 6))
    best = F.max_by(F.struct("bin", "between"), F.struct("between", -F.col("bin"))).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("b.bin").alias("threshold_bin"), F.col("b.between").alias("between_variance"))


def otsu2(hist: DataFrame, *keys: str) -> DataFrame:
    """The two bins up to which the lower two of three classes reach: between-class variance is largest, the first pair of equal ones.

    Pairs are made of a group's bins, at most bins**2 / 2 for each group, whatever the stack.
    """
    w = Window.partitionBy(*keys)
    up = w.orderBy("bin")
    sums = hist.select(*keys, "bin", F.sum("n").over(up).cast("double").alias("n"), F.sum(F.col("n") * F.col("bin")).over(up).cast("double").alias("s"), F.sum("n").over(w).cast("double").alias("nt"), F.sum(F.col("n") * F.col("bin")).over(w).cast("double").alias("st")).where("n < nt")
    later = sums.select(*keys, F.col("bin").alias("bin2"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    pairs = sums.join(later, list(keys)).where("bin < bin2")
    # numbers of bins and pixels are whole, so every square below is exact
    between = F.expr("(s * s / n + (s2 - s) * (s2 - s) / (n2 - n) + (st - s2) * (st - s2) / (nt - n2)) / nt - (st / nt) * (st / nt)")
    best = F.max_by(F.struct("bin", "bin2", "v"), F.struct("v", -F.col("bin"), -F.col("bin2"))).alias("b")
    return pairs.withColumn("v", F.round(between, 6)).groupBy(*keys).agg(best).select(*keys, F.col("b.bin").alias("threshold1_bin"), F.col("b.bin2").alias("threshold2_bin"), F.col("b.v").alias("between_variance"))


def basic_threshold(hist: DataFrame, bins: int, *keys: str, dt: float = 0.5, most: int = 100) -> DataFrame:
    """The basic global threshold: half way between the means of the values up to it and beyond it, repeated until it moves by less than `dt`.

    Works on a group's bins as an array, each at its place between the least and the greatest value. Null if all values are the same.
    """
    value = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / (bins - 1)
    rows = hist.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.collect_list(F.struct(value.alias("x"), F.col("n"))).alias("h"))  # at most `bins` entries

    def mean(inside):
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
        total = F.aggregate("h", zero, lambda a, e: F.struct((a["s"] + F.when(inside(e["x"]), e["x"] * e["n"]).otherwise(0.0)).alias("s"), (a["n"] + F.when(inside(e["x"]), e["n"]).otherwise(0)).alias("n")))
        return F.try_divide(total["s"], total["n"])

    def step(state, _):
        new = (mean(lambda x: x <= state["t"]) + mean(lambda x: x > state["t"])) * 0.5
        moved = F.struct(new.alias("t"), (F.abs(new - state["t"]) < dt).alias("done"))
        return F.when(state["done"], state).otherwise(moved)

    start = F.struct(((F.col("lo") + F.col("hi")) * 0.5).alias("t"), F.lit(False).alias("done"))
    found = rows.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["t"].alias("t"))
    return found.select(*keys, F.round("t", 6).alias("threshold"))


def above(pixels: DataFrame, threshold: DataFrame, *keys: str) -> DataFrame:
    """Values strictly above their group's threshold."""
    limit = checked(threshold, "thresholds")
    return pixels.join(limit, list(keys)).groupBy(*keys).agg(F.first("threshold").alias("threshold"), F.count_if(F.col("v") > F.col("threshold")).alias("n_above"))


def otsu3(hist: DataFrame, *keys: str) -> DataFrame:
    """The three bins up to which the lower three of four classes reach; as for two, of a group's bins only: at most bins**3 / 6 triples for each group, so bins should be few."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("bin")
    sums = hist.select(*keys, "bin", F.sum("n").over(up).cast("double").alias("n"), F.sum(F.col("n") * F.col("bin")).over(up).cast("double").alias("s"), F.sum("n").over(w).cast("double").alias("nt"), F.sum(F.col("n") * F.col("bin")).over(w).cast("double").alias("st")).where("n < nt")
    later = lambda i: sums.select(*keys, F.col("bin").alias(f"bin{i}"), F.col("n").alias(f"n{i}"), F.col("s").alias(f"s{i}"))
    triples = sums.join(later(2), list(keys)).where("bin < bin2").join(later(3), list(keys)).where("bin2 < bin3")
    between = F.expr("(s * s / n + (s2 - s) * (s2 - s) / (n2 - n) + (s3 - s2) * (s3 - s2) / (n3 - n2) + (st - s3) * (st - s3) / (nt - n3)) / nt - (st / nt) * (st / nt)")
    best = F.max_by(F.struct("bin", "bin2", "bin3", "v"), F.struct("v", -F.col("bin"), -F.col("bin2"), -F.col("bin3"))).alias("b")
    names = [F.col(f"b.bin{i or ''}").alias(f"threshold{max(i, 1)}_bin") for i in (0, 2, 3)]
    return triples.withColumn("v", F.round(between, 6)).groupBy(*keys).agg(best).select(*keys, *names, F.col("b.v").alias("between_variance"))


def equalised_values(pixels: DataFrame, hist: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Pixels as the cumulative share of the bin nearest to their value: the histogram-equalised stack."""
    w = Window.partitionBy(*keys)
    limits = checked(hist.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi")), "limits")
    up = hist.select(*keys, "bin", (F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).alias("share"))
    # a bin without pixels has the share of the one before it
    until = F.lead("bin", 1, bins).over(w.orderBy("bin"))
    shares = checked(up.withColumn("until", until).select(*keys, "share", F.explode(F.sequence(F.col("bin"), F.col("until") - 1)).alias("bin")), "shares")
    place = F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("lo")) * (bins - 1), F.col("hi") - F.col("lo")) + 0.5), F.lit(0))
    return pixels.join(limits, list(keys)).withColumn("bin", place).join(shares, [*keys, "bin"]).drop("lo", "hi", "bin", "v").withColumnRenamed("share", "v")
