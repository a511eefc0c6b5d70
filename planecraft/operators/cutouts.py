"""Windows round points, cut from images in blocks: points meet blocks by the keys of the blocks that their windows touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_out(points: DataFrame, blocks: DataFrame, block: int, window: tuple[int, int, int], *keys: str) -> DataFrame:
    """(point columns, z0, y0, x0, nz, ny, nx, data) of points (keys, id, pz, py, px) and blocks (keys, z, by, bx, ny, nx, data).

    A window of size w round p begins at ceil(p - w / 2); what lies beyond the image is cut off, and a
    point whose window misses the image has no row. ids tell points apart; windows are small, so each is
    put together in one row. Planes that are rows are blocks with by = bx = 0 and a block size of theirs.
    """
    first = lambda c, w: F.ceil(F.col(c) - w / 2).cast("long")
    wz, wy, wx = window
    spots = points.select(*keys, "id", "pz", "py", "px", first("pz", wz).alias("sz"), first("py", wy).alias("sy"), first("px", wx).alias("sx"))
    over = lambda c, w: F.sequence(F.floor(F.greatest(F.col(c), F.lit(0)) / block), F.floor((F.col(c) + w - 1) / block))
    spots = spots.where((F.col("sz") + wz > 0) & (F.col("sy") + wy > 0) & (F.col("sx") + wx > 0))
    touched = spots.withColumn("z", F.explode(F.sequence(F.greatest("sz", F.lit(0)), F.col("sz") + wz - 1))).withColumn("by", F.explode(over("sy", wy))).withColumn("bx", F.explode(over("sx", wx)))
    held = blocks.select(*keys, F.col("z").cast("long").alias("z"), F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), "ny", "nx", "data")
    both = touched.join(held, [*keys, "z", "by", "bx"])
    y0, y1 = F.greatest(F.col("sy") - F.col("by") * block, F.lit(0)), F.least(F.col("sy") + wy - F.col("by") * block, F.col("ny"))
    x0, x1 = F.greatest(F.col("sx") - F.col("bx") * block, F.lit(0)), F.least(F.col("sx") + wx - F.col("bx") * block, F.col("nx"))
    both = both.select("*", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")).where("y1 > y0 AND x1 > x0")
    line = lambda r: F.struct((F.col("by") * block + r).alias("y"), (F.col("bx") * block + F.col("x0")).alias("x"), F.slice("data", (r * F.col("nx") + F.col("x0") + 1).cast("int"), (F.col("x1") - F.col("x0")).cast("int")).alias("v"))
    lines = both.select(*keys, "id", "pz", "py", "px", "z", F.explode(F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), line)).alias("l"))
    held = F.array_sort(F.collect_list(F.struct("z", "l.y", "l.x", "l.v")))
    windows = lines.groupBy(*keys, "id", "pz", "py", "px").agg(held.alias("l"))
    low, high = (lambda c: F.array_min(F.transform("l", lambda s: s[c]))), (lambda c: F.array_max(F.transform("l", lambda s: s[c])))
    last = F.array_max(F.transform("l", lambda s: s["x"] + F.size(s["v"]) - 1))
    return windows.select(
        *keys, "id", "pz", "py", "px", low("z").alias("z0"), low("y").alias("y0"), low("x").alias("x0"),
        (high("z") - low("z") + 1).alias("nz"), (high("y") - low("y") + 1).alias("ny"), (last - low("x") + 1).alias("nx"), F.flatten(F.transform("l", lambda s: s["v"])).alias("data"),
    )
