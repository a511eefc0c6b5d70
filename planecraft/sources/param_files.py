"""Alignment parameters as text: five header lines (nt, nw, pixel sizes, reference, names), then a row for each frame and channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planecraft.operators.params import NAMES

COLUMNS = ("t", "wavelength", *NAMES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, wavelength, tz ... mx) of all parameter files under a path; cells that are no numbers are null, header lines go."""
    cells = F.split("value", ",")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), cells.alias("c"))
    rows = lines.where((F.size("c") == len(COLUMNS)) & F.get("c", F.lit(0)).rlike(r"^\s*\d+\s*$"))
    return rows.select("file", F.get("c", F.lit(0)).try_cast("int").alias("t"), *[F.get("c", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(COLUMNS) if i])


def lines(params: DataFrame, reference: int, pixel: tuple[float, float, float]) -> DataFrame:
    """(value) lines of one file in order, for `write.text`. params: (t, wavelength, tz ... mx)."""
    head = params.agg(F.count_distinct("t").alias("nt"), F.count_distinct("wavelength").alias("nw"))
    made = head.select(F.posexplode(F.array(F.concat(F.lit("nt,"), "nt"), F.concat(F.lit("nw,"), "nw"), F.lit("pxlsize_z_y_x," + ",".join(map(str, pixel))), F.lit(f"refwave,{reference}"), F.lit(",".join(COLUMNS)))).alias("nth", "value"))
    rows = params.select(F.concat_ws(",", *COLUMNS).alias("value"), "t", "wavelength")
    numbered = made.select("value", F.lit(-1).alias("t"), F.col("nth").cast("double").alias("wavelength")).unionByName(rows.select("value", F.col("t").cast("int"), F.col("wavelength").cast("double")))
    return numbered.coalesce(1).sortWithinPartitions("t", "wavelength").select("value")  # a file of frames x channels rows


def write(params: DataFrame, path: str) -> None:
    """Parameters (file, t, w, wave, tz ... mx, reference, pz, py, px) as text, in a folder `file=NAME` for each file. `reference` is a channel's number."""
    cell = lambda c: F.col(c).cast("string")
    rows = params.select("file", F.lit(5).alias("at"), F.col("t").cast("long").alias("t"), F.col("w").cast("long").alias("w"), F.concat_ws(",", cell("t"), cell("wave"), *map(cell, NAMES)).alias("value"))
    files = params.groupBy("file").agg(F.count_distinct("t").alias("nt"), F.count_distinct("w").alias("nw"), *[F.max(c).alias(c) for c in ("reference", "pz", "py", "px")])
    head = [F.concat_ws(",", F.lit("nt"), cell("nt")), F.concat_ws(",", F.lit("nw"), cell("nw")), F.concat_ws(",", F.lit("pxlsize_z_y_x"), *map(cell, ("pz", "py", "px"))), F.concat_ws(",", F.lit("refwave"), cell("reference")), F.lit(",".join(COLUMNS))]
    none = F.lit(0).cast("long")
    first = files.select("file", F.posexplode(F.array(*head)).alias("at", "value")).select("file", "at", none.alias("t"), none.alias("w"), "value")
    ordered = first.unionByName(rows).repartition("file").sortWithinPartitions("file", "at", "t", "w")  # a file has a line for each frame and channel
    ordered.select("file", "value").write.mode("append").partitionBy("file").text(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, nt, nw, pz, py, px, reference): what the first four lines of each file say, by their place; null where one holds no number."""
    from planecraft.sources.array_text import lines as numbered

    cells = F.split("value", ",")
    first = numbered(spark, path).where("line < 4").select("file", "line", cells.alias("c"))
    places = {"nt": (0, 1, "int"), "nw": (1, 1, "int"), "pz": (2, 1, "double"), "py": (2, 2, "double"), "px": (2, 3, "double"), "reference": (3, 1, "int")}
    value = lambda line, i, kind: F.max(F.when(F.col("line") == line, F.get("c", F.lit(i)).try_cast(kind)))
    return first.groupBy("file").agg(*[value(*place).alias(n) for n, place in places.items()])
