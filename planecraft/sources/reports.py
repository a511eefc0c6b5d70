"""Reports over many files: tables whose columns differ from file to file, and summaries of parameter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planecraft.operators.params import NAMES, SHIFTS, ZOOMS
from planecraft.sources import array_text, param_files

#: A comma outside quotation marks.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(value):
    return F.transform(F.split(value, _COMMA, -1), lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), '""', '"'))


def tables(spark: SparkSession, path: str, title_line: int = 0) -> DataFrame:
    """(file, line, fields): the lines of CSV files after each file's own titles, as maps from title to cell. A line with
    fewer cells lacks fields, further cells go, and of equal titles the last counts. Lines end where the file's lines do."""
    lines = array_text.lines(spark, path)
    titles = lines.where(F.col("line") == title_line).select("file", _cells("value").alias("titles"))
    rows = lines.where((F.col("line") > title_line) & (F.trim("value") != "")).select("file", "line", _cells("value").alias("cells"))
    pairs = F.arrays_zip(F.slice("titles", F.lit(1), F.size("cells")), F.slice("cells", F.lit(1), F.size("titles")))
    both = rows.join(titles, "file").select("file", "line", pairs.alias("p"))
    entry = F.transform("p", lambda s: F.struct(s["0"].alias("key"), s["1"].alias("value")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda o: o["key"] == e["key"]))
    return both.select("file", "line", F.map_from_entries(last).alias("fields"))


def chosen(rows: DataFrame, **columns: tuple[str, list[str]]) -> DataFrame:
    """(file, line, columns) of tables: for each column its type and the titles that it may have; null where a file has none or the cell is of another type."""
    value = lambda kind, names: F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in names]).try_cast(kind)
    return rows.select("file", "line", *[value(kind, names).alias(c) for c, (kind, names) in columns.items()])


def summary(spark: SparkSession, path: str, pixels: tuple[int, int, int]) -> DataFrame:
    """(file, time, wave, tz ... mx, total): of all parameter files under a path, each channel's deviation from its file's
    reference channel in the same frame, in nanometres, for images of `pixels` (z, y, x). The reference itself has no row.

    Rotation counts as the way of the image's middle about the origin, zooms as the way of the middle.
    """
    head = param_files.headers(spark, path).select("file", "pz", "py", "px", "reference")
    own = param_files.read(spark, path)
    waves = own.groupBy("file").agg(F.array_sort(F.collect_set("wavelength")).alias("waves"))  # a file's channels
    known = head.join(waves, "file").select("file", "pz", "py", "px", F.get("waves", F.col("reference")).alias("refwave"))
    rows = own.join(known, "file")
    # a frame's channels are few; its reference is found beside them, so no row is joined to it
    frame = Window.partitionBy("file", "t")
    ref = {c: F.max(F.when(F.col("wavelength") == F.col("refwave"), F.col(c))).over(frame) for c in NAMES}
    apart = rows.select("file", "t", "wavelength", "refwave", "pz", "py", "px", *[(F.col(c) - ref[c]).alias(c) for c in SHIFTS], *[(F.col(c) / ref[c]).alias(c) for c in ZOOMS]).where("wavelength <> refwave")
    size = dict(zip("zyx", ("pz", "py", "px")))
    middle = dict(zip("zyx", (n / 2 for n in pixels)))
    nm = {f"t{a}": F.col(f"t{a}") * F.col(size[a]) * 1000 for a in "zyx"}
    angle = F.radians("r")
    turned = F.cos(angle) * middle["y"] + F.sin(angle) * middle["x"] - middle["y"], F.cos(angle) * middle["x"] - F.sin(angle) * middle["y"] - middle["x"]
    nm["r"] = F.sqrt(turned[0] * turned[0] + turned[1] * turned[1]) * (F.col("py") + F.col("px")) / 2 * 1000
    nm |= {f"m{a}": F.abs(F.col(f"m{a}") - 1) * middle[a] * F.col(size[a]) * 1000 for a in "zyx"}
    made = apart.select("file", F.col("t").alias("time"), F.col("wavelength").alias("wave"), *[nm[c].alias(c) for c in NAMES])
    return made.withColumn("total", F.sqrt(sum(F.col(c) * F.col(c) for c in NAMES)))
