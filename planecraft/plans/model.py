"""The two layouts of image stacks: sections (a plane in a row) and pixels (a value in a row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as planes of 8 x 8: (z, w, ny, nx, data)."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return rows.select(F.col("vec_id").alias("z"), F.col("label").alias("w"), F.lit(8).alias("ny"), F.lit(8).alias("nx"), F.col("embedding").cast("array<double>").alias("data"))


def to_pixels(planes: DataFrame) -> DataFrame:
    """(z, w, y, x, v) from sections; y is the outer index."""
    keys = [c for c in planes.columns if c not in ("data", "ny")]
    p = planes.select(*keys, F.posexplode("data").alias("p", "v"))
    return p.select(*[c for c in keys if c != "nx"], F.expr("cast(p div nx as bigint)").alias("y"), F.expr("cast(p % nx as bigint)").alias("x"), "v")


def to_sections(pixels: DataFrame, *keys: str) -> DataFrame:
    """Planes from pixels, ordered by y and x; a plane has a bounded number of pixels."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return pixels.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("data"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a stack of ten channels, whose planes meet in z: (z, w, ny, nx, data)."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return rows.select(F.floor(F.col("vec_id") / 10).alias("z"), (F.col("vec_id") % 10).alias("w"), F.lit(8).alias("ny"), F.lit(8).alias("nx"), F.col("embedding").cast("array<double>").alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_pixels(sections(spark, sf_dir))


#: The same pixels for the oracle.
PIXELS_SQL = """pixels AS (
  SELECT vec_id AS z, label AS w, CAST(p // 8 AS BIGINT) AS y, CAST(p % 8 AS BIGINT) AS x, CAST(embedding[p + 1] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(64)) AS p))"""

STACK_SQL = """stack AS (
  SELECT vec_id // 10 AS z, vec_id % 10 AS w, CAST(p // 8 AS BIGINT) AS y, CAST(p % 8 AS BIGINT) AS x, CAST(embedding[p + 1] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(64)) AS p))"""
