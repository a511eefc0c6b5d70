"""Queries of images in blocks, of holes in grids, and of sections in files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.operators import blocks, holes
from planecraft.plans.catalogue import query
from planecraft.plans.model import sections, table
from planecraft.plans.storage import scratch
from planecraft.sources import section_files


def mosaic_blocks(spark, d) -> DataFrame:
    """Every embedding as a block of 8 x 8 pixels of an image of 64 blocks; the last image lacks some."""
    k = F.col("z") % 64
    return sections(spark, d).select(F.floor(F.col("z") / 64).alias("m"), F.floor(k / 8).cast("int").alias("by"), (k % 8).cast("int").alias("bx"), "ny", "nx", "data")


def _pixels(rows: DataFrame) -> DataFrame:
    p = rows.select("m", "by", "bx", "nx", F.posexplode("data").alias("p", "v"))
    place = lambda b, i: (F.col(b) * 8 + F.expr(i)).cast("long")
    return p.select("m", place("by", "p div nx").alias("y"), place("bx", "p % nx").alias("x"), (F.round("v", 6) + 0.0).alias("v"))


# a pixel of the block where it lies, else of the block beside, else of the block above or below, else of the own
_BLOCKS = """b AS (SELECT vec_id // 64 AS m, (vec_id % 64) // 8 AS bi, vec_id % 8 AS bj, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT *, greatest(least(y + dy, 7), 0) AS cy, greatest(least(x + dx, 7), 0) AS cx, (y + dy + 8) % 8 AS ry, (x + dx + 8) % 8 AS rx, bi + (y + dy + 8) // 8 - 1 AS oi, bj + (x + dx + 8) // 8 - 1 AS oj
      FROM (SELECT m, bi, bj, q // 8 AS y, q % 8 AS x, e FROM b, (SELECT unnest(range(64)) AS q)), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)),
n AS (SELECT p.m, p.bi * 8 + p.y AS y, p.bj * 8 + p.x AS x, dy, dx, coalesce(o.e[ry * 8 + rx + 1], s.e[cy * 8 + rx + 1], u.e[ry * 8 + cx + 1], p.e[cy * 8 + cx + 1]) AS v
      FROM p LEFT JOIN b o ON o.m = p.m AND o.bi = oi AND o.bj = oj LEFT JOIN b s ON s.m = p.m AND s.bi = p.bi AND s.bj = oj LEFT JOIN b u ON u.m = p.m AND u.bi = oi AND u.bj = p.bj)"""


@query(f"WITH {_BLOCKS} SELECT m, y, x, round(sum(v * [1, 4, 6, 4, 1][dy + 3] * [1, 4, 6, 4, 1][dx + 3] / 256), 6) + 0.0 AS v FROM n GROUP BY m, y, x")
def block_smoothed(spark, d):
    return _pixels(blocks.smoothed(mosaic_blocks(spark, d), [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16], "m"))


@query(
    f"""WITH {_BLOCKS} SELECT m, y, x, round(sqrt(pow(sum(CASE WHEN dx = 0 AND abs(dy) = 1 THEN dy * v ELSE 0 END) / 2, 2) + pow(sum(CASE WHEN dy = 0 AND abs(dx) = 1 THEN dx * v ELSE 0 END) / 2, 2)), 6) + 0.0 AS v
    FROM n GROUP BY m, y, x"""
)
def block_gradient(spark, d):
    return _pixels(blocks.gradient(mosaic_blocks(spark, d), "m"))


def _holes_sql(rounds: int) -> str:
    """Rounds written out; eight rows and columns are filled after four."""
    first = """g0 AS (SELECT vec_id AS z, label AS w, p // 8 AS i, p % 8 AS j, CAST(embedding[p + 1] AS DOUBLE) AS dy, -2 * CAST(embedding[p + 1] AS DOUBLE) AS dx,
      CASE WHEN embedding[p + 1] > 0.2 THEN 0 END AS round FROM embeddings, (SELECT unnest(range(64)) AS p))"""
    steps = [first]
    for r in range(1, rounds + 1):
        reach = " AND ".join(
            f"b.{c} BETWEEN a.{c} - CASE WHEN a.{c} < {r} THEN 0 ELSE {r} END AND a.{c} + CASE WHEN a.{c} >= {r} AND a.{c} > 8 - {r} THEN 0 ELSE {r} END" for c in "ij"
        )
        steps.append(
            f"""n{r} AS (SELECT a.z, a.i, a.j, avg(b.dy) / {2 ** (r - 1)} AS dy, avg(b.dx) / {2 ** (r - 1)} AS dx FROM g{r - 1} a JOIN g{r - 1} b ON a.z = b.z AND a.round IS NULL AND b.round IS NOT NULL AND {reach} GROUP BY a.z, a.i, a.j),
    g{r} AS (SELECT g.z, g.w, g.i, g.j, coalesce(n.dy, g.dy) AS dy, coalesce(n.dx, g.dx) AS dx, CASE WHEN n.z IS NULL THEN g.round ELSE {r} END AS round FROM g{r - 1} g LEFT JOIN n{r} n USING (z, i, j))"""
        )
    return "WITH " + ", ".join(steps) + f" SELECT z, w, i, j, round(dy, 6) + 0.0 AS dy, round(dx, 6) + 0.0 AS dx, round FROM g{rounds}"


@query(_holes_sql(4))
def filled_holes(spark, d):
    """Every embedding as a grid of 8 x 8 tile shifts, of which those above a limit were accepted."""
    grid = sections(spark, d).select("z", "w", F.posexplode("data").alias("p", "v"))
    tiles = grid.select("z", "w", F.floor(F.col("p") / 8).alias("i"), (F.col("p") % 8).cast("long").alias("j"), F.col("v").alias("dy"), (-2 * F.col("v")).alias("dx"), (F.col("v") > 0.2).alias("accepted"))
    filled = holes.fill(tiles, "z", "w")
    return filled.select("z", "w", "i", "j", (F.round("dy", 6) + 0.0).alias("dy"), (F.round("dx", 6) + 0.0).alias("dx"), "round")


def section_folder(spark, d) -> str:
    """All embeddings as sections of image files, ten to a file."""
    v, rows = F.col("vec_id"), table(spark, d, "embeddings").where("embedding IS NOT NULL")
    frame = {"t": 0, "w": 0}
    made = {"ny": 8, "nx": 8, "dtype": "float32", "pz": 0.2, "py": 0.1, "px": 0.1}
    planes = rows.select(
        F.format_string("stack-%06d.mrc", F.floor(v / 10)).alias("file"), *[F.lit(x).cast("long").alias(c) for c, x in frame.items()], (v % 10).alias("z"),
        *[F.lit(x).alias(c) for c, x in made.items()], F.lit(488.0).alias("wave"), F.col("embedding").cast("array<double>").alias("data"),
    )
    path = scratch(spark, "images")
    section_files.write(planes, path)
    return path


def _stack():
    return F.regexp_extract("file", r"stack-([0-9]+)\.mrc$", 1).cast("long").alias("stack")
_E = "SELECT vec_id // 10 AS stack, vec_id % 10 AS z, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL"


@query(f"SELECT stack, z, 488.0::DOUBLE AS wave, e AS data FROM ({_E}) WHERE z BETWEEN 3 AND 5")
def file_section_range(spark, d):
    """Sections 3 to 5 of every image file; no others are read."""
    return section_files.read(spark, section_folder(spark, d)).where("z BETWEEN 3 AND 5").select(_stack(), "z", "wave", "data")


@query(f"SELECT stack, z, CAST(len(list_filter(e, lambda v: v >= 0.3)) AS INT) AS n FROM ({_E}) WHERE list_max(e) >= 0.3")
def bright_sections(spark, d):
    """Pixels above a limit; sections whose zone map stays below it aren't read."""
    bright = section_files.read(spark, section_folder(spark, d)).where("v_max >= 0.3")
    return bright.select(_stack(), "z", F.size(F.filter("data", lambda v: v >= 0.3)).alias("n"))


@query(f"SELECT stack, count(*) AS sections, min(list_min(e)) AS v_min, max(list_max(e)) AS v_max, round(avg(list_avg(e)), 4) AS v_mean FROM ({_E}) GROUP BY stack")
def file_index(spark, d):
    """Lowest, highest and mean value of each file, from its zone map alone."""
    index = section_files.read(spark, section_folder(spark, d), data=False)
    return index.groupBy(_stack()).agg(F.count("*").alias("sections"), F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"), F.round(F.avg("v_mean"), 4).alias("v_mean"))
