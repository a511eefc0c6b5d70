"""N-d arrays as text: leading index columns, comments, blocks set off by blank lines; plain, gzip or bzip2.

Lines get their number, and rows their place in an array, from counts of each split and sums over the
splits before: no file passes through one task, unless it is compressed whole and can't be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, block, nth, value): line counts from 0; a block is one of Spark's splits, and nth the place in it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = counts.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "block", (F.col("id") - F.col("first")).alias("nth"), "value")


def _counted(rows: DataFrame, flag: str, name: str, *keys: str) -> DataFrame:
    """How many rows with a flag stand before each row, of the same file and keys: counted in a split and over the splits before."""
    own = Window.partitionBy("file", "block", *keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "block", *keys).agg(F.sum(F.col(flag).cast("long")).alias("n"))
    over = Window.partitionBy("file", *keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "block", *keys, F.coalesce(F.sum("n").over(over), F.lit(0)).alias("earlier"))
    marked = rows.withColumn("own", F.coalesce(F.sum(F.col(flag).cast("long")).over(own), F.lit(0)))
    return marked.join(sums, ["file", "block", *keys]).withColumn(name, F.col("earlier") + F.col("own")).drop("earlier", "own")


def rows(spark: SparkSession, path: str, ndim: int = 2, separator: str | None = None, comment: str = "#", skip: int = 0, columns: list[int] | None = None, parted: bool = False) -> DataFrame:
    """(file, dataset, index, row, values) of all text arrays under a path.

    Of `ndim` dimensions the first ndim - 2 columns of a line are its index and the others its values, in
    order of their lines; cells that are no numbers are null. What follows a comment mark is no part of a line.
    Blank lines are skipped, or, where arrays are `parted`, set datasets off from each other, however many stand
    together; `skip` lines begin each file.
    Cells are parted by white space unless a separator is given; `columns` are chosen before the index is taken.
    """
    text = F.trim(F.regexp_replace(F.regexp_extract("value", rf"^([^\Q{comment}\E]*)", 1), r"\s+$", ""))
    held = lines(spark, path).where(F.col("line") >= skip).select("file", "block", "nth", "line", text.alias("text"), (F.trim("value") == "").alias("blank"))
    held = held.where("blank OR text <> ''")
    held = (_counted(held, "blank", "blanks") if parted else held.withColumn("blanks", F.lit(0).cast("long"))).where("NOT blank")
    sets = held.select("file", "blanks").distinct()
    numbered = sets.select("file", "blanks", (F.row_number().over(Window.partitionBy("file").orderBy("blanks")) - 1).cast("long").alias("dataset"))  # a row for each dataset of a file
    cells = F.split("text", r"\s+") if separator is None else F.split("text", F.lit(f"\\Q{separator}\\E"))
    numbers = F.transform(cells, lambda c: F.trim(c).try_cast("double"))
    if columns is not None:
        numbers = F.transform(F.array(*map(F.lit, columns)), lambda k: F.get(numbers, k))
    held = held.select("file", "block", "nth", "blanks", numbers.alias("cells"))
    held = held.select("file", "block", "nth", "blanks", F.transform(F.slice("cells", 1, ndim - 2), lambda c: c.cast("int")).alias("index") if ndim > 2 else F.array().cast("array<int>").alias("index"), F.slice("cells", ndim - 1, 1 << 30).alias("values"))
    placed = _counted(held.withColumn("one", F.lit(True)), "one", "row", "blanks", "index").join(numbered, ["file", "blanks"])
    return placed.select("file", "dataset", "index", "row", "values")


def cells(arrays: DataFrame) -> DataFrame:
    """(file, dataset, index, row, col, v): a row for each number."""
    return arrays.select("file", "dataset", "index", "row", F.posexplode("values").alias("col", "v"))


def text(arrays: DataFrame, separator: str = "\t") -> DataFrame:
    """(value) lines of arrays (index, row, values), sorted, for `write.text`; the rows of an index come into one file."""
    line = F.concat_ws(separator, F.transform("index", lambda i: i.cast("string")), F.transform("values", lambda v: v.cast("string")))
    ordered = arrays.repartitionByRange("index").sortWithinPartitions("index", "row")
    return ordered.select(line.alias("value"))
