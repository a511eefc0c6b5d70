"""Series of image files, one plane a file: what their names say, and what is missing or there twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planecraft.functions.names import place_in_series, stem
from planecraft.plans.storage import stored


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files under a folder; nothing is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


#: Places by position: `name_t_w_z`.
_THREE = r"_([0-9]+)_([^_/]+)_([0-9]+)$"


def _parts(paths: DataFrame) -> DataFrame:
    """(path, folder, base, t, w, z): what a name's marks say. A row of its own for each name, so that no part is found again wherever it is used."""
    file = F.substring_index("path", "/", -1)
    folder = F.left("path", F.length("path") - F.length(file))
    parts = F.struct(folder.alias("folder"), stem(file).alias("base"), *[place_in_series(F.col("path"), a).alias(a) for a in "twz"])
    return paths.select("path", F.inline(F.array(parts)))


def manifest(paths: DataFrame) -> DataFrame:
    """(series, path, t, w, z): places by marks like `_z001-t02_c1`; where no name of a series has one, by the last three numbers `name_t_w_z`.

    A series is a folder and the name without its marks and numbers. An axis that the names don't mark is 0.
    Only names without marks meet the labels of their series; the others are not shuffled.
    """
    marked = F.coalesce("t", "w", "z").isNotNull()
    by_marks = _parts(paths).where(marked).select(
        F.concat("folder", F.regexp_replace("base", "[_-][zZtTwWcC][0-9]+", "")).alias("series"), "path", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in "twz"]
    )
    ending = _THREE.removesuffix("$") + r"\R?(\.[^./]*)?$"  # all whose stem ends so, and some more
    plain = _parts(paths.where(F.col("path").rlike(ending))).where(~marked & F.col("base").rlike(_THREE))
    last = lambda g: F.regexp_extract("base", _THREE, g)
    rows = plain.select(F.concat("folder", F.regexp_replace("base", _THREE, "")).alias("series"), "path", last(1).alias("t"), last(2).alias("label"), last(3).alias("z"))
    labels = rows.groupBy("series").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # channels of a series
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)).alias(c)
    by_numbers = rows.join(labels, "series").select("series", "path", number("t"), (F.array_position("labels", F.col("label")) - 1).alias("w"), number("z"))
    return by_marks.unionByName(by_numbers)


def missing(series: DataFrame) -> DataFrame:
    """(series, t, w, z): places of the grid of a series' frames, channels and sections without a file. The places that have one are stored, so names are parsed once."""
    cells = stored(series.select("series", "t", "w", "z").distinct(), "cells")
    grid, *others = (cells.select("series", c).distinct() for c in "twz")
    for axis in others:
        grid = grid.join(axis, "series")
    return grid.join(cells, ["series", "t", "w", "z"], "leftanti")


def repeated(series: DataFrame) -> DataFrame:
    """(series, t, w, z, files): places with several files."""
    return series.groupBy("series", "t", "w", "z").agg(F.count("*").alias("files")).where("files > 1")


def shapes(series: DataFrame) -> DataFrame:
    """(series, nt, nw, nz, files)."""
    return series.groupBy("series").agg(*[F.count_distinct(c).alias("n" + c) for c in "twz"], F.count("*").alias("files"))
