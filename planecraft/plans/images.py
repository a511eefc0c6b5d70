"""Queries of whole images: reference channels, averages, tiles, maps and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from planecraft.functions import text
from planecraft.operators import alignment, local, stacks
from planecraft.plans.catalogue import _long, query
from planecraft.plans.model import sections, table
from planecraft.plans.storage import scratch
from planecraft.sources import section_files

_FRAME = {"ny": 8, "nx": 8, "dtype": "float32", "pz": 0.2, "py": 0.1, "px": 0.1}


def _image(spark, d, file, w, z, wave, t=lambda v: F.lit(0)):
    v = F.col("vec_id")
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    made = [F.lit(x).alias(c) for c, x in _FRAME.items()]
    places = [f(v).cast("long").alias(c) for c, f in (("t", t), ("w", w), ("z", z))]
    return rows.select(file(v).cast("string").alias("file"), *places, wave(v).cast("double").alias("wave"), *made, F.col("embedding").cast("array<double>").alias("data"))


@query(
    """WITH c AS (SELECT vec_id // 50 AS file, vec_id % 10 AS w, any_value(400.0 + vec_id % 10 * 7 % 10 * 20) AS wave, avg(list_avg(embedding::DOUBLE[])) AS m FROM embeddings GROUP BY 1, 2),
    r AS (SELECT *, wave > min(wave) OVER i AND wave < max(wave) OVER i AND m > avg(m) OVER i / 1.25 AS good, count(*) OVER i AS nw FROM c WINDOW i AS (PARTITION BY file))
    SELECT CAST(file AS VARCHAR) AS file, w FROM r QUALIFY row_number() OVER (PARTITION BY file ORDER BY CASE WHEN nw <= 2 THEN 0 WHEN good THEN 1 ELSE 2 END, CASE WHEN nw <= 2 THEN 0 ELSE -m END, w) = 1"""
)
def reference_channels(spark, d):
    """Of images of ten channels and five sections, the channel that the others are aligned to."""
    return alignment.best_channels(_image(spark, d, lambda v: F.floor(v / 50), lambda v: v % 10, lambda v: F.floor(v % 50 / 10), lambda v: 400.0 + v % 10 * 7 % 10 * 20))


@query(
    """WITH p AS (SELECT vec_id % 5 AS file, vec_id // 5 AS z, q, CAST(embedding[q + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS q)),
    n AS (SELECT file, max(z) + 1 AS nz FROM p GROUP BY file), l AS (SELECT min(nz) AS least FROM n)
    SELECT p.z - (nz - least) // 2 AS z, q // 8 AS y, q % 8 AS x, round(avg(v), 6) + 0.0 AS v FROM p JOIN n USING (file), l WHERE p.z - (nz - least) // 2 BETWEEN 0 AND least - 1 GROUP BY ALL"""
)
def averaged_images(spark, d):
    """The mean of five images whose sections are the embeddings in turn."""
    made = alignment.averaged(_image(spark, d, lambda v: v % 5, lambda v: F.lit(0), lambda v: F.floor(v / 5), lambda v: F.lit(488.0)), "mean")
    p = made.select("z", "nx", F.posexplode("data").alias("p", "v"))
    return p.select("z", F.expr("cast(p div nx as bigint)").alias("y"), F.expr("cast(p % nx as bigint)").alias("x"), (F.round("v", 6) + 0.0).alias("v"))


@query(
    """WITH s AS (SELECT unnest([0, 2, 4]) AS a), e AS (SELECT vec_id AS z, label AS w, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT z, w, CAST(r.a // 2 AS INT) AS i, CAST(c.a // 2 AS INT) AS j, CAST(r.a AS INT) AS y0, CAST(c.a AS INT) AS x0, round(any_value((SELECT var_pop(v) FROM (SELECT unnest(e) AS v))), 6) AS spread,
      list(e[(r.a + k // 4) * 8 + c.a + k % 4 + 1] ORDER BY k) AS data
    FROM e, s r, s c, (SELECT unnest(range(16)) AS k) GROUP BY z, w, r.a, c.a"""
)
def tiles(spark, d):
    """Tiles of 4 x 4 pixels, which overlap by half, and the variance of their plane."""
    made = local.tiles(sections(spark, d), 8, 8, 4)
    return made.select("z", "w", "i", "j", "y0", "x0", F.round("spread", 6).alias("spread"), "data")


_MAP = "SELECT vec_id AS z, label AS w, p // 8 AS y, p % 8 AS x, p // 8 - 0.25 * (p % 8) / 7 AS sy, p % 8 + 0.5 AS sx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, (SELECT unnest(range(64)) AS p)"
_CORNERS = " + ".join(f"({'sy - iy' if a else '1 - sy + iy'}) * ({'sx - ix' if b else '1 - sx + ix'}) * CASE WHEN iy + {a} BETWEEN 0 AND 7 AND ix + {b} BETWEEN 0 AND 7 THEN e[(iy + {a}) * 8 + ix + {b} + 1] ELSE 0 END" for a in (0, 1) for b in (0, 1))


@query(f"SELECT z, w, y, x, round({_CORNERS}, 6) + 0.0 AS v FROM (SELECT *, CAST(floor(sy) AS BIGINT) AS iy, CAST(floor(sx) AS BIGINT) AS ix FROM ({_MAP}))")
def remapped_planes(spark, d):
    """Planes read through a map of shifts that grows along x."""
    planes = sections(spark, d)
    pixels = F.sequence(F.lit(0), F.lit(63))
    maps = planes.select("z", F.col("w").cast("long").alias("w"), F.transform(pixels, lambda p: (p % 8) / 28.0).alias("dy"), F.transform(pixels, lambda p: F.lit(-0.5)).alias("dx"))
    return _long(local.remapped(planes, maps)).withColumn("w", F.col("w").cast("int")).withColumn("v", F.round("v", 6) + 0.0)


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_brand AS brand, p_type AS type, CAST(NULL AS VARCHAR) AS missing FROM part")
def settings(spark, d):
    """Settings of lines `key=value` that each part's fields make, and back."""
    lines = F.concat(F.lit("# a part\nsize="), "p_size", F.lit("\nbrand = "), "p_brand", F.lit("\n\ntype="), "p_type", F.lit("\n"))
    held = table(spark, d, "part").select("p_partkey", text.settings(lines).alias("s"))
    return held.select("p_partkey", *[F.try_element_at("s", F.lit(k)).alias(k) for k in ("size", "brand", "type", "missing")])


def _stacks(spark, d):
    """The embeddings as images of two channels, five sections and two frames."""
    return _image(
        spark, d, lambda v: F.format_string("stack-%05d.mrc", F.floor(v / 20)), lambda v: v % 2, lambda v: F.floor(v % 10 / 2), lambda v: 488.0 + v % 2 * 73, lambda v: F.floor(v % 20 / 10)
    )


def _written(spark, d):
    path = scratch(spark, "images")
    section_files.write(_stacks(spark, d), path, gaps=True)  # the last image may end early
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    return section_files.read(spark, path).withColumn("file", name)


def _number():
    return F.regexp_extract("file", "stack-([0-9]+)", 1).cast("long").alias("stack")
_FILES = """f AS (SELECT vec_id // 20 AS stack, vec_id % 20 // 10 AS t, vec_id % 2 AS w, vec_id % 10 // 2 AS z, 488 + vec_id % 2 * 73 AS wave, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)"""
_EACH = "SELECT *, q // 8 AS y, q % 8 AS x, e[q + 1] AS v FROM f, (SELECT unnest(range(64)) AS q)"


@query(f"WITH {_FILES} SELECT stack, t, 1 - w AS w, z - 1 AS z, list_concat(e[19:22], e[27:30], e[35:38]) AS data FROM f WHERE z BETWEEN 1 AND 3")
def file_region(spark, d):
    """Sections 1 to 3, both channels in the other order, rows 2 to 4 and columns 2 to 5 of every image file."""
    return stacks.region(_written(spark, d), w=[1, 0], z=(1, 4), y=(2, 5), x=(2, 6)).select(_number(), "t", "w", "z", "data")


@query(f"WITH {_FILES} SELECT stack * 2 + t AS t, w, z, e AS data FROM f")
def merged_files(spark, d):
    """All image files as one, frame after frame."""
    return stacks.merged(_written(spark, d), "t", "all.mrc", gaps=True).select("t", "w", "z", "data")


@query(f"WITH {_FILES} SELECT stack, max(t) + 1 AS nt, max(w) + 1 AS nw, max(z) + 1 AS nz, CAST(8 AS INT) AS ny, CAST(8 AS INT) AS nx, 'float32' AS dtype, CASE WHEN max(t) > 0 THEN 'T' ELSE '' END || 'WZYX' AS axes, [488.0::DOUBLE, 561.0::DOUBLE] AS waves FROM f GROUP BY stack")
def file_shapes(spark, d):
    return stacks.shapes(_written(spark, d), "WZYX").select(_number(), "nt", "nw", "nz", "ny", "nx", "dtype", "axes", "waves")


@query(f"WITH {_FILES}, m AS (SELECT stack, wave, avg(v + 1) AS m FROM ({_EACH}) GROUP BY stack, wave) SELECT stack, wave, round(m / max(m) OVER (PARTITION BY stack), 6) AS level FROM m")
def spectra(spark, d):
    """Level of each channel over that of the brightest, of every image."""
    bright = _stacks(spark, d).withColumn("data", F.transform("data", lambda v: v + 1))
    return stacks.spectra(bright).select(_number(), "wave", F.round("level", 6).alias("level"))


@query(f"WITH {_FILES} SELECT stack AS w, t, z, y, x, round(avg(v), 6) + 0.0 AS v FROM ({_EACH}) GROUP BY stack, t, z, y, x")
def summed_channels(spark, d):
    """An image with a channel for each image, the mean of its channels."""
    made = stacks.summed_channels(_stacks(spark, d), "sum.mrc", gaps=True)
    p = made.select("w", "t", "z", "nx", F.posexplode("data").alias("p", "v"))
    return p.select("w", "t", "z", F.expr("cast(p div nx as bigint)").alias("y"), F.expr("cast(p % nx as bigint)").alias("x"), (F.round("v", 6) + 0.0).alias("v"))


@query(
    f"""WITH {_FILES}, p AS (SELECT stack, w, y, x, avg(v + 1) AS m FROM ({_EACH}) WHERE stack = 0 GROUP BY stack, w, y, x), g AS (SELECT w, y, x, avg(m) OVER (PARTITION BY w) / m AS g FROM p)
    SELECT stack, t, w, z, y, x, round((v + 1) * g, 6) AS v FROM ({_EACH}) JOIN g USING (w, y, x)"""
)
def flattened_images(spark, d):
    """Every image with the flat field of the first."""
    bright = _stacks(spark, d).withColumn("data", F.transform("data", lambda v: v + 1))
    made = stacks.flattened(bright, stacks.flat_fields(bright.where("file = 'stack-00000.mrc'")))
    p = made.select(_number(), "t", "w", "z", "nx", F.posexplode("data").alias("p", "v"))
    return p.select("stack", "t", "w", "z", F.expr("cast(p div nx as bigint)").alias("y"), F.expr("cast(p % nx as bigint)").alias("x"), F.round("v", 6).alias("v"))


@query(f"WITH {_FILES} SELECT stack, t, w, z, e AS dy, list_reverse(e) AS dx FROM f")
def map_files(spark, d):
    """Maps of shifts, made of each embedding and its mirror image, written as image files and read."""
    maps = _stacks(spark, d).withColumn("dy", F.col("data")).withColumn("dx", F.reverse("data"))
    path = scratch(spark, "maps")
    section_files.write(stacks.map_sections(maps), path, gaps=True)
    return stacks.section_maps(section_files.read(spark, path)).select(_number(), "t", "w", "z", "dy", "dx")


@query("SELECT doc_id, line, value FROM (SELECT doc_id, unnest(lines) AS value, generate_subscripts(lines, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(value, '[0-9]{3}')")
def grep_lines(spark, d):
    """Lines of documents with a three-figure number, and their number in the text."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.where(F.col("value").rlike("[0-9]{3}")).select("doc_id", (F.col("line") + 1).cast("long").alias("line"), "value")
