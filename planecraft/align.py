"""Align the channels of image files: `python -m planecraft.align TARGET... -R REFERENCE... -O FOLDER`.

References are image files or parameter files, in folders or by name. Parameters are found in image files, or read,
and written as text into FOLDER/parameters; targets read through them go as image files into FOLDER/images.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planecraft.operators import alignment, params
from planecraft.plans.storage import stored
from planecraft.sources import param_files, section_files


def _planes(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = section_files.read(spark, paths[0])
    for p in paths[1:]:
        found = found.unionByName(section_files.read(spark, p))
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    return found.select(name.alias("file"), "t", "w", "z", "ny", "nx", "dtype", "wave", "pz", "py", "px", "data")


def find(spark: SparkSession, references: list[str], average: bool = False, reference_wave: float | None = None, max_shift: float | None = None) -> DataFrame:
    """(file, t, w, wave, tz ... mx, reference, pz, py, px) of reference images; max_shift in micrometres."""
    planes = _planes(spark, references)
    if average:
        planes = stored(alignment.averaged(planes, "average.mrc"), "average")
    best = alignment.best_channels(planes)
    if reference_wave is not None:
        best = planes.where(F.round("wave") == round(reference_wave)).groupBy("file").agg(F.min("w").alias("w"))
    best = stored(best, "best")
    size = planes.groupBy("file").agg(*[F.max(c).alias(c) for c in ("pz", "py", "px")])
    how = {}
    if max_shift is not None:
        pixel = size.agg(F.min(F.least("py", "px")).alias("p")).first()["p"]
        how["max_shift"] = max_shift / pixel
    return alignment.parameters(planes, best, **how).join(best.withColumnRenamed("w", "reference"), "file").join(size, "file")


def read_parameters(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parameter files as `find` gives them, relative to their own reference channel."""
    own = param_files.read(spark, paths).withColumnRenamed("wavelength", "wave")
    waves = own.groupBy("file").agg(F.array_sort(F.collect_set("wave")).alias("waves"))  # a file's channels
    return own.join(param_files.headers(spark, paths), "file").join(waves, "file").select("file", "t", (F.array_position("waves", F.col("wave")) - 1).alias("w"), "wave", *params.NAMES, "reference", "pz", "py", "px")


def one_set(found: DataFrame) -> DataFrame:
    """(t, wave, tz ... mx): the mean over files of shifts and zooms, by frame and wavelength."""
    return found.groupBy("t", F.round("wave").alias("wave")).agg(*[F.avg(c).alias(c) for c in params.NAMES])


def run(spark: SparkSession, targets: list[str], references: list[str], out: str, average: bool = False, reference_wave: float | None = None, max_shift: float | None = None, crop: bool = True) -> None:
    texts = all(r.rsplit(".", 1)[-1].lower() in ("csv", "txt") or "/parameters" in r for r in references)
    if texts:
        found = read_parameters(spark, references)
    else:
        found = stored(find(spark, references, average, reference_wave, max_shift), "found")
        param_files.write(found, f"{out}/parameters")
    whole = alignment.applied(_planes(spark, targets), stored(one_set(found), "parameters"), crop)
    name = F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit("_aligned.mrc"))
    first = whole.groupBy("file").agg(F.min("z").alias("z0"))
    numbered = whole.join(first, "file").withColumn("z", F.col("z") - F.col("z0")).drop("z0")
    section_files.write(numbered.withColumn("file", name), f"{out}/images")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Align the channels of image files.")
    p.add_argument("targets", nargs="+", help="image files or folders, as URIs or absolute paths")
    p.add_argument("-R", "--reference", nargs="+", required=True, help="image files, or parameter files, to take the alignment from")
    p.add_argument("-O", "--output", required=True, help="folder of what is written")
    p.add_argument("-a", "--average", action="store_true", help="average the reference images first")
    p.add_argument("-r", "--reference-wave", type=float, help="wavelength of the channel that stays; found if not given")
    p.add_argument("-s", "--max-shift", type=float, help="longest shift, in micrometres")
    p.add_argument("-c", "--keep-margins", action="store_true", help="don't cut margins that not all channels cover")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("planecraft.align").getOrCreate()
    run(spark, a.targets, a.reference, a.output, a.average, a.reference_wave, a.max_shift, not a.keep_margins)


if __name__ == "__main__":
    main()
