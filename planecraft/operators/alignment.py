"""Channels of whole images aligned: the reference channel, parameters of the others, images read through them.

Images are sections (file, t, w, z, ny, nx, dtype, wave, pz, py, px, data). What is compared are the
projections of a channel; their pixels are combined in each task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planecraft.operators.fitting import images, in_portions
from planecraft.operators.kernels import affine
from planecraft.operators.params import NAMES, SHIFTS, ZOOMS
from planecraft.operators.registration import aligned, shift_between
from planecraft.plans.shipping import ship
from planecraft.plans.storage import checked, stored

#: The highest value of the types that saturate.
HIGHEST = {"uint8": 255, "int16": 32767, "uint16": 65535, "int32": 2147483647}
LOWEST = {"uint8": 0, "int16": -32768, "uint16": 0, "int32": -2147483648}


def _limit(table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(float(v) if isinstance(v, int) else v) for pair in table.items() for v in pair]), F.col("dtype"))


def best_channels(planes: DataFrame) -> DataFrame:
    """(file, w): the channel that the others of an image are aligned to.

    Of one or two channels the first. Else, of the channels with a middle wavelength (neither the least nor the greatest), without
    a saturated pixel and brighter than the image's mean over 1.25, the brightest; if there is none, the brightest of all. Of equal ones the first.
    """
    full = F.when(_limit(HIGHEST).isNotNull(), F.exists("data", lambda v: v >= _limit(HIGHEST))).otherwise(False)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    each = planes.select("file", "w", "wave", full.alias("full"), total.alias("total"), F.size("data").alias("n"))
    rows = each.groupBy("file", "w").agg(F.max("wave").alias("wave"), F.max("full").alias("full"), (F.sum("total") / F.sum("n")).alias("mean"))  # a row for each channel
    image = Window.partitionBy("file")
    rows = rows.select("*", F.count("*").over(image).alias("nw"), F.min("wave").over(image).alias("least"), F.max("wave").over(image).alias("most"), F.avg("mean").over(image).alias("level"))
    rank = F.when(F.col("nw") <= 2, 0).when((F.col("wave") > F.col("least")) & (F.col("wave") < F.col("most")) & ~F.col("full") & (F.col("mean") > F.col("level") / 1.25), 1).otherwise(2)
    bright = F.when(F.col("nw") <= 2, 0.0).otherwise(-F.col("mean"))
    return rows.groupBy("file").agg(F.min(F.struct(rank.alias("rank"), bright.alias("bright"), "w")).alias("b")).select("file", "b.w")


def averaged(planes: DataFrame, file: str) -> DataFrame:
    """The mean of several images as one, called `file`. Images of more sections give those about their middle; they must have the same frames and channels."""
    sizes = checked(planes.groupBy("file").agg((F.max("z") + 1).alias("nz")), "sizes")
    least = sizes.agg(F.min("nz").alias("least"), F.count("*").alias("files"))
    both = planes.join(sizes, "file").join(F.broadcast(least), F.col("nz") >= F.col("least"))  # one row
    z = F.col("z") - F.floor((F.col("nz") - F.col("least")) / 2)
    moved = both.withColumn("z", z).where((F.col("z") >= 0) & (F.col("z") < F.col("least")))
    keys = ["t", "w", "z", "ny", "nx"]
    frame = moved.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("dtype", "wave", "pz", "py", "px")], F.count("*").alias("n"), F.first("files").alias("files"))
    pixels = moved.select(*keys, F.posexplode("data").alias("p", "v")).groupBy(*keys, "p").agg(F.avg("v").alias("v"))
    data = pixels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("data"))
    same = F.when(F.col("n") == F.col("files"), F.col("data")).otherwise(F.raise_error(F.lit("images to be averaged differ in frames, channels or size")))
    return frame.join(data, keys).select(F.lit(file).alias("file"), "t", "w", "z", "ny", "nx", F.lit("float32").alias("dtype"), "wave", "pz", "py", "px", same.alias("data"))


def _projected(planes: DataFrame, along: str) -> DataFrame:
    """(id, w, ny, nx, data): brightest pixels of a channel along z or x."""
    pixels = planes.select("id", "w", "z", "nx", F.posexplode("data").alias("p", "v"))
    y, x = F.floor(F.col("p") / F.col("nx")), F.col("p") % F.col("nx")
    row, column = (y, x) if along == "z" else (F.col("z"), y)
    top = pixels.groupBy("id", "w", row.alias("r"), column.alias("c")).agg(F.max("v").alias("v"))
    made = top.groupBy("id", "w").agg((F.max("r") + 1).cast("int").alias("ny"), (F.max("c") + 1).cast("int").alias("nx"), F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("s"))
    return made.select("id", "w", "ny", "nx", F.transform("s", lambda e: e["v"].cast("double")).alias("data"))


def _lowered(a: np.ndarray, by: float) -> np.ndarray:
    """Rows moved down by a part of a row; rows from beyond the edge are as those at it."""
    at = np.clip(np.arange(len(a)) - by, 0, len(a) - 1)
    up = np.minimum(np.floor(at).astype(int), len(a) - 2)
    part = (at - up)[:, None]
    return a[up] * (1 - part) + a[up + 1] * part


def _depth(a: np.ndarray, b: np.ndarray, rounds: int = 4) -> float:
    """By how many rows a has to go down to meet b; what is left after a move is added."""
    tz = 0.0
    for _ in range(rounds):
        left = float(shift_between(_lowered(a, tz), b, reach=a.shape[0] / 4)[0][0])
        tz += left
        if abs(left) < 0.01 or abs(tz) > a.shape[0] / 2:
            break
    return tz if abs(tz) <= a.shape[0] / 2 else 0.0


def _along_z(pairs: DataFrame) -> DataFrame:
    """(id, w, tz) of side views (id, w, ny, nx, data, ref), z down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_depth(a, b) for a, b in zip(images(batch), images(batch, "ref"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("w"), pa.array(found, pa.float64())], ["id", "w", "tz"])

    return pairs.select("id", "w", "ny", "nx", "data", "ref").mapInArrow(run, "id long, w long, tz double")


def parameters(planes: DataFrame, references: DataFrame | None = None, least_sections: int = 8, **how: object) -> DataFrame:
    """(file, t, w, wave, tz ... mx) that bring every channel of every frame onto the image's reference channel, (file, w) in `references`.

    Planes of an image have one size. Shift along z is found from side views of images with enough sections, else it is 0;
    zoom along z is 1. A frame without its reference channel gives no rows.
    """
    ship(planes.sparkSession)
    best = checked(best_channels(planes) if references is None else references, "references")
    waves = stored(planes.groupBy("file", "t", "w").agg(F.max("wave").alias("wave"), F.count("*").alias("nz")).withColumn("id", F.monotonically_increasing_id()), "channels")
    frames = stored(waves.groupBy("file", "t").agg(F.min("id").alias("id")), "frames")
    rows = planes.select("file", "t", F.col("w").cast("long").alias("w"), "z", "ny", "nx", "data").join(frames, ["file", "t"])
    reference = frames.join(best.select("file", F.col("w").cast("long").alias("refw")), "file").select("id", "refw")
    top = stored(_projected(rows, "z"), "projections")
    ref = top.join(reference, "id").where(F.col("w") == F.col("refw")).select(F.col("id").alias("z"), F.col("data").alias("ref"))
    others = top.join(reference, "id").where(F.col("w") != F.col("refw")).select(F.col("id").alias("z"), "w", "ny", "nx", "data")
    found = aligned(others, ref, **how).select(F.col("z").alias("id"), "w", "ty", "tx", "r", "my", "mx")
    deep = waves.where(F.col("nz") >= least_sections).select("file", "t", "w")
    side = stored(_projected(rows.join(deep, ["file", "t", "w"], "leftsemi"), "x"), "sides").join(reference, "id")
    pairs = side.where(F.col("w") != F.col("refw")).join(side.where(F.col("w") == F.col("refw")).select("id", F.col("data").alias("ref"), F.col("ny").alias("h")), "id").where(F.col("ny") == F.col("h"))
    depth = _along_z(pairs)
    own = waves.drop("id").join(frames, ["file", "t"]).join(reference, "id")
    both = own.join(found, ["id", "w"], "left").join(depth, ["id", "w"], "left").where((F.col("w") == F.col("refw")) | F.col("ty").isNotNull())
    rest = {**{c: 0.0 for c in SHIFTS}, **{c: 1.0 for c in ZOOMS}}
    value = {c: F.coalesce(F.col(c), F.lit(rest[c])) if c != "mz" else F.lit(1.0) for c in NAMES}
    return both.select("file", "t", "w", "wave", *[value[c].alias(c) for c in NAMES])


def _in_z(planes: DataFrame) -> DataFrame:
    """Sections shifted by tz and zoomed by mz about the middle of their channel; 0 beyond its ends. Channels that stay are not mixed anew."""
    keys = ["file", "t", "w"]
    ends = planes.groupBy(*keys).agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    middle = (F.col("z0") + F.col("z1")) / 2
    low = F.greatest(F.col("z0"), F.ceil((F.col("z") - 1 - middle) * F.col("mz") + middle + F.col("tz")))
    high = F.least(F.col("z1"), F.floor((F.col("z") + 1 - middle) * F.col("mz") + middle + F.col("tz")))
    to = planes.join(checked(ends, "ends"), keys).where(low <= high).withColumn("to", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    share = 1 - F.abs((F.col("to") - middle - F.col("tz")) / F.col("mz") + middle - F.col("z"))
    parts = to.withColumn("share", share).where("share > 0")
    kept = [c for c in planes.columns if c not in (*keys, "z", "data")]
    met = parts.groupBy(*keys, "to").agg(*[F.first(c).alias(c) for c in kept], F.array_sort(F.collect_list(F.struct("z", "share", "data"))).alias("s"))  # two sections, or some more if the stack shrinks
    none = F.transform(F.get("s", F.lit(0))["data"], lambda v: F.lit(0.0))
    sums = F.aggregate("s", none, lambda a, p: F.zip_with(a, p["data"], lambda x, v: x + v * p["share"]))
    return met.select(*keys, F.col("to").alias("z"), *kept, sums.alias("data"))


def applied(planes: DataFrame, params: DataFrame, crop: bool = True, order: int = 1) -> DataFrame:
    """Images read through parameters (t, wave, tz ... mx), matched by rounded wavelength; a wavelength without any stays as it is.

    One frame of parameters holds for all frames; of several, frames without their own stay. Whole numbers are rounded and
    kept in their type's range, and an image whose least value is 0 gets no value below. With `crop` the margins that not all
    channels and frames of an image cover are cut off in y and x.
    """
    ship(planes.sparkSession)
    one = params.select("t").distinct().count() == 1
    p = params.select(F.col("t").alias("pt"), F.round("wave").cast("int").alias("k"), *NAMES).dropDuplicates(["pt", "k"])
    p = checked(p, "parameters")
    meet = (F.round("wave").cast("int") == F.col("k")) if one else (F.round("wave").cast("int") == F.col("k")) & (F.col("t") == F.col("pt"))
    whole = planes.withColumn("data", F.col("data").cast("array<double>")).join(p, meet, "left").drop("pt", "k")
    rest = {**{c: 0.0 for c in SHIFTS}, **{c: 1.0 for c in ZOOMS}}
    whole = stored(whole.select(*planes.columns, *[F.coalesce(c, F.lit(rest[c])).alias(c) for c in NAMES]), "targets")
    lo = lambda c: F.ceil(F.greatest(F.col(c), F.lit(0.0)))
    hi = lambda c, n: F.floor(F.col(n) + F.least(F.col(c), F.lit(0.0)))
    box = whole.groupBy("file").agg(
        F.max(lo("ty")).cast("int").alias("y0"), F.min(hi("ty", "ny")).cast("int").alias("y1"), F.max(lo("tx")).cast("int").alias("x0"), F.min(hi("tx", "nx")).cast("int").alias("x1"), F.min(F.array_min("data")).alias("least")
    )
    still = whole.where("tz = 0 AND mz = 1")
    moved = still.unionByName(_in_z(whole.where("NOT (tz = 0 AND mz = 1)")).select(whole.columns))
    turning = ["ty", "tx", "r", "my", "mx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches):
            rest = np.array([0.0, 0.0, 0.0, 1.0, 1.0])
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in turning], 1)
            made = [(a if (q == rest).all() else affine(a, *q, order=order)).ravel() for a, q in zip(images(batch), values)]
            kept = batch.drop_columns(["data"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(made, pa.list_(pa.float64()))], [*kept.schema.names, "data"])

    columns = [c for c in moved.columns if c != "data"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moved.select(columns).schema)
    turned = moved.select(*columns, "data").mapInArrow(run, kinds + ", data array<double>").join(checked(box, "boxes"), "file")
    floor = F.when(F.col("least") == 0, 0.0)
    low, high = F.coalesce(_limit(LOWEST), floor), _limit(HIGHEST)
    kept = F.transform("data", lambda v: F.when(high.isNotNull(), F.least(F.greatest(F.rint(v), low), high)).when(low.isNotNull(), F.greatest(v, low)).otherwise(v))
    turned = turned.withColumn("data", kept)
    if crop:
        line = lambda y: F.slice("data", y * F.col("nx") + F.col("x0") + 1, F.col("x1") - F.col("x0"))
        fits = (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))
        turned = turned.where(fits).withColumn("data", F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), line)))
        turned = turned.withColumn("ny", F.col("y1") - F.col("y0")).withColumn("nx", F.col("x1") - F.col("x0"))
    return turned.select(planes.columns)
