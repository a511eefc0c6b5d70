"""Whole images as tables of sections (file, t, w, z, ny, nx, dtype, wave, pz, py, px, data): regions, merging, shapes, levels, flat fields and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planecraft.plans.storage import checked

Span = tuple[int, int] | list[int] | None


def region(planes: DataFrame, t: Span = None, w: Span = None, z: Span = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """Part of every image, numbered from 0 again. t, w and z: first and beyond last, as a tuple, or a list of places, whose
    order counts; y and x: first and beyond last pixel. Conditions on t, w and z stand next to the source, so other sections aren't read."""
    out = planes
    for axis, span in (("t", t), ("w", w), ("z", z)):
        if isinstance(span, tuple):
            out = out.where((F.col(axis) >= span[0]) & (F.col(axis) < span[1])).withColumn(axis, F.col(axis) - span[0])
        elif span is not None:
            places = F.array(*[F.lit(int(i)).cast("long") for i in span])
            out = out.where(F.col(axis).isin([int(i) for i in span])).withColumn(axis, F.array_position(places, F.col(axis).cast("long")) - 1)
    if y is None and x is None:
        return out
    y0, y1 = (F.lit(0), F.col("ny")) if y is None else (F.lit(y[0]), F.least(F.lit(y[1]), F.col("ny")))
    x0, x1 = (F.lit(0), F.col("nx")) if x is None else (F.lit(x[0]), F.least(F.lit(x[1]), F.col("nx")))
    line = lambda r: F.slice("data", r * F.col("nx") + x0 + 1, x1 - x0)
    cut = out.where((y1 > y0) & (x1 > x0)).withColumn("data", F.flatten(F.transform(F.sequence(y0, y1 - 1), line)))
    return cut.withColumn("ny", (y1 - y0).cast("int")).withColumn("nx", (x1 - x0).cast("int"))


def shapes(planes: DataFrame, always: str = "") -> DataFrame:
    """(file, nt, nw, nz, ny, nx, dtype, axes, waves): axes names those longer than 1, and those of `always`, in the order TWZYX; waves by channel. A row for each file."""
    size = planes.groupBy("file").agg(
        *[(F.max(c) + 1).alias("n" + c) for c in "twz"], F.max("ny").alias("ny"), F.max("nx").alias("nx"), F.first("dtype").alias("dtype"),
        F.transform(F.array_sort(F.collect_set(F.struct("w", "wave"))), lambda s: s["wave"]).alias("waves"),
    )
    axes = F.concat(*[F.lit(a) if a in always else F.when(F.col("n" + a.lower()) > 1, a).otherwise("") for a in "TWZYX"])
    return size.select("file", "nt", "nw", "nz", "ny", "nx", "dtype", axes.alias("axes"), "waves")


def merged(planes: DataFrame, along: str, file: str, gaps: bool = False) -> DataFrame:
    """All images as one, one after the other along t, w or z in the order of their names. Their other axes must agree;
    with `gaps` only their planes' size and type, and an image that ends early leaves its places empty."""
    others = [] if gaps else [c for c in "twz" if c != along]
    sizes = planes.groupBy("file").agg((F.max(along) + 1).alias("size"), F.concat_ws("x", *[(F.max(c) + 1).cast("string") for c in (*others, "ny", "nx")], F.min("dtype"), F.max("dtype")).alias("shape"))
    sizes = checked(sizes, "sizes")  # a row for each file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    kinds = sizes.agg(F.count_distinct("shape").alias("kinds"))
    placed = sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    rows = planes.join(checked(placed, "places"), "file").join(F.broadcast(kinds), F.col("kinds") >= 1)  # one row
    place = F.when(F.col("kinds") == 1, F.col(along) + F.col("offset")).otherwise(F.raise_error(F.lit("images of one shape and type can be merged")))
    return rows.withColumn(along, place).withColumn("file", F.lit(file)).select(planes.columns)


def _mean_planes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, data): mean of planes of one size, pixel by pixel; a task adds up its planes before they are shuffled."""
    pixels = rows.select(*keys, F.posexplode("data").alias("p", "v")).groupBy(*keys, "p").agg(F.avg("v").alias("v"))
    return pixels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("data"))


def _total(data: str = "data") -> Column:
    return F.aggregate(data, F.lit(0.0), lambda a, v: a + v)


def spectra(planes: DataFrame) -> DataFrame:
    """(file, wave, level): the mean of each channel over the highest mean of its image; wavelengths are rounded."""
    means = planes.select("file", "w", "wave", _total().alias("s"), F.size("data").alias("n")).groupBy("file", "w").agg(F.max("wave").alias("wave"), (F.sum("s") / F.sum("n")).alias("mean"))
    return means.select("file", F.round("wave").cast("long").alias("wave"), F.try_divide(F.col("mean"), F.max("mean").over(Window.partitionBy("file"))).alias("level"))  # a row for each channel


def summed_channels(planes: DataFrame, file: str, gaps: bool = False) -> DataFrame:
    """One image with a channel for each file, in the order of their names: the mean of the file's channels. With `gaps`, files may differ in frames and sections."""
    frame = planes.groupBy("file", "t", "z", "ny", "nx").agg(*[F.min(c).alias(c) for c in ("dtype", "pz", "py", "px", "wave")])
    rows = frame.join(_mean_planes(planes, "file", "t", "z"), ["file", "t", "z"]).withColumn("w", F.lit(0).cast("long"))
    return merged(rows.select(planes.columns), "w", file, gaps)


def flat_fields(planes: DataFrame) -> DataFrame:
    """(file, w, wave, ny, nx, data): gain of every pixel of a channel, the mean over the pixel's mean in all frames and sections."""
    frame = planes.groupBy("file", "w").agg(*[F.max(c).alias(c) for c in ("wave", "ny", "nx")])
    rows = frame.join(_mean_planes(planes, "file", "w"), ["file", "w"])
    mean = _total() / F.size("data")
    return rows.withColumn("mean", mean).withColumn("data", F.transform("data", lambda v: F.try_divide(F.col("mean"), v))).drop("mean")


def flattened(planes: DataFrame, flats: DataFrame) -> DataFrame:
    """Pixels times the gain of their wavelength (rounded) and place; channels without a gain of their size stay."""
    gains = checked(flats.select(F.round("wave").cast("long").alias("k"), F.col("ny").alias("gy"), F.col("nx").alias("gx"), F.col("data").alias("gain")), "gains", 1000)
    both = planes.join(gains, (F.round("wave").cast("long") == F.col("k")) & (F.col("ny") == F.col("gy")) & (F.col("nx") == F.col("gx")), "left")
    made = F.zip_with("data", "gain", lambda v, g: v * F.coalesce(g, F.lit(1.0)))
    return both.withColumn("data", F.when(F.col("gain").isNotNull(), made).otherwise(F.col("data").cast("array<double>"))).select(planes.columns)


def map_sections(maps: DataFrame) -> DataFrame:
    """Maps of shifts (file, t, w, z, ny, nx, wave, pz, py, px, dy, dx) as sections of an image, for the sink: dy of map z is section 2 z, dx the next."""
    both = F.explode(F.array(F.struct((F.col("z") * 2).alias("z"), F.col("dy").alias("data")), F.struct((F.col("z") * 2 + 1).alias("z"), F.col("dx").alias("data")))).alias("s")
    return maps.select("file", "t", "w", both, "ny", "nx", F.lit("float32").alias("dtype"), "wave", "pz", "py", "px").select("file", "t", "w", "s.z", "ny", "nx", "dtype", "wave", "pz", "py", "px", "s.data")


def section_maps(sections: DataFrame) -> DataFrame:
    """The maps of such an image, back: (file, t, w, z, ny, nx, wave, pz, py, px, dy, dx)."""
    one = lambda k: F.max(F.when(F.col("z") % 2 == k, F.col("data")))
    keys = ["file", "t", "w", F.floor(F.col("z") / 2).alias("z"), "ny", "nx", "wave", "pz", "py", "px"]
    return sections.groupBy(*keys).agg(one(0).alias("dy"), one(1).alias("dx"))
