"""Queries of focus, drift, stacks laid over each other, peak statistics, beads, Zernike planes, structuring elements and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from planecraft.functions import names, text
from planecraft.operators import beads, focus, generated, measure, reduce, region, registration
from planecraft.plans.catalogue import query
from planecraft.plans.model import STACK_SQL, stack, table, to_pixels
from planecraft.plans.stacks import mosaics

_POLAR = "SELECT *, sqrt(dy * dy + dx * dx) / 6 AS r, atan2(dy, dx) AS a FROM (SELECT y, x, y - 7.5 AS dy, x - 5.5 AS dx FROM (SELECT unnest(range(16)) AS y), (SELECT unnest(range(12)) AS x))"
_ZERNIKE = {0: "1", 1: "r * cos(a)", 2: "r * sin(a)", 3: "2 * r * r - 1", 6: "(3 * r * r * r - 2 * r) * cos(a)", 7: "(3 * r * r * r - 2 * r) * sin(a)", 8: "6 * r * r * r * r - 6 * r * r + 1", 9: "r * r * r * cos(3 * a)"}


@query(f"SELECT y, x, {', '.join(f'round(CASE WHEN r <= 1 THEN {e} ELSE 0 END::DOUBLE, 6) + 0.0 AS n{n}' for n, e in _ZERNIKE.items())}, round(2 * r * r - 1, 6) + 0.0 AS whole FROM ({_POLAR})")
def zernike_planes(spark, d):
    made = generated.made(spark, 16, 12, **{f"n{n}": generated.zernike(n, 16, 12) for n in _ZERNIKE}, whole=generated.zernike(3, 16, 12, crop=False))
    return made.select("y", "x", *[(F.col(c) + 0.0).alias(c) for c in made.columns[2:]])


@query(
    """SELECT 'steps' AS kind, z, y, x, z = 1 AND abs(y - 1) + abs(x - 1) <= 1 AS v FROM (SELECT unnest(range(3)) AS z), (SELECT unnest(range(3)) AS y), (SELECT unnest(range(3)) AS x)
    UNION ALL SELECT 'disc', z, y, x, z = 1 AND (y - 2) * (y - 2) + (x - 2) * (x - 2) <= 6.25 FROM (SELECT unnest(range(3)) AS z), (SELECT unnest(range(5)) AS y), (SELECT unnest(range(5)) AS x)"""
)
def structuring_elements(spark, d):
    both = {"steps": generated.neighbourhood(spark, 1), "disc": generated.flat_disc(spark)}
    steps, disc = (e.select(F.lit(n).alias("kind"), "z", "y", "x", "v") for n, e in both.items())
    return steps.unionAll(disc)


@query(
    f"""WITH {STACK_SQL}, f AS (SELECT unnest(range(8)) AS fy), g AS (SELECT unnest(range(5)) AS fx),
    ring AS (SELECT fy, fx FROM f, g WHERE pow(least(fy, 8 - fy), 2) + fx * fx BETWEEN 1 AND 4),
    a AS (SELECT z, w, fy, fx, sqrt(pow(sum(v * cos(2 * pi() * (fy * y + fx * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (fy * y + fx * x) / 8)), 2)) AS size FROM stack, ring GROUP BY z, w, fy, fx),
    s AS (SELECT z, w, sum(size) AS score FROM a GROUP BY z, w),
    i AS (SELECT s.* FROM s JOIN (SELECT w, min(z) AS z0, max(z) AS z1 FROM s GROUP BY w) e ON s.w = e.w AND s.z > e.z0 AND s.z < e.z1)
    SELECT i.z, i.w, round(i.score, 6) AS score FROM i JOIN (SELECT w, avg(score) + 0.5 * stddev_pop(score) AS least FROM i GROUP BY w) l ON i.w = l.w AND i.score > l.least"""
)
def focus_sections(spark, d):
    return focus.in_focus(stack(spark, d)).select("z", "w", F.round("score", 6).alias("score"))


@query()
def time_drift(spark, d):
    """Of each mosaic, moved by a known step from frame to frame in two channels: what is found, against frame 0."""
    steps = spark.range(4).selectExpr("id AS w", "1.5D * id AS ty", "-0.75D * id AS tx", "0D AS r", "1D AS my", "1D AS mx")
    frames = mosaics(spark, d).withColumn("w", F.explode(F.expr("sequence(0L, 3L)")))
    moved = registration.applied(frames, steps).withColumnsRenamed({"z": "image", "w": "t"})
    return registration.drift(moved.withColumn("w", F.explode(F.expr("array(0L, 1L)"))), 0, 0)


_DARK = "CASE WHEN v > 0.1 THEN v ELSE 0 END"


@query(f"WITH {STACK_SQL}, l AS (SELECT z AS t, w, min({_DARK}) AS lo FROM stack GROUP BY z, w) SELECT bool_and(lo = 0) AS zero FROM l")
def floor_at_zero(spark, d):
    dark = F.transform("data", lambda v: F.when(v > 0.1, v).otherwise(0.0))
    return region.floor_is_zero(stack(spark, d).select(F.col("z").alias("t"), "w", dark.alias("data")))


@query(
    f"""WITH {STACK_SQL}, n AS (SELECT max(z) + 1 AS n FROM stack), one AS (SELECT w, z - 2 AS z, y, x, v FROM stack, n WHERE z >= 2 AND z < n - 3), two AS (SELECT w, z - 5 AS z, y, x, -v AS v FROM stack WHERE z >= 5)
    SELECT w, z, y, x, greatest(one.v, two.v) AS v FROM one JOIN two USING (w, z, y, x)"""
)
def stacks_laid_over(spark, d):
    one = stack(spark, d).withColumn("t", F.lit(0))
    two = one.where("z >= 5").withColumn("data", F.transform("data", lambda v: -v))
    laid = region.maximum_of([one, two]).select("w", "z", F.lit(8).alias("ny"), F.lit(8).alias("nx"), "data")
    return to_pixels(laid)


_PEAKS = "SELECT label AS w, CAST(embedding[1] AS DOUBLE) AS h, round(abs(CAST(embedding[2] AS DOUBLE)), 1) AS sy, round(abs(CAST(embedding[3] AS DOUBLE)), 1) AS sx FROM embeddings"
_WIDE = {"height": "h", "width_y": "sy * 0.08 * 2 * sqrt(2 * ln(2))", "width_x": "sx * 0.1 * 2 * sqrt(2 * ln(2))"}


@query(f"SELECT w, {', '.join(f'round(avg({e}), 6) AS {n}_mean, round(stddev_pop({e}), 6) AS {n}_std' for n, e in _WIDE.items())}, count(*) AS n FROM ({_PEAKS}) WHERE sy <> sx GROUP BY w")
def peak_statistics(spark, d):
    n = lambda i: F.get("embedding", F.lit(i)).cast("double")
    peaks = table(spark, d, "embeddings").select(F.col("label").alias("w"), n(0).alias("height"), F.round(F.abs(n(1)), 1).alias("sigma_y"), F.round(F.abs(n(2)), 1).alias("sigma_x"))
    return measure.peak_statistics(peaks, (0.08, 0.1), "w")


@query(
    f"""WITH {STACK_SQL}, i AS (SELECT CAST(unnest(range(3)) AS BIGINT) AS image), p AS (SELECT image, w, z, y, x, v * (1 + image * y) AS v FROM stack, i WHERE w IN (0, 1) AND z >= 2 * image AND x >= image AND y <= 7 - image),
    k AS (SELECT * FROM p WHERE z BETWEEN 5 AND (SELECT max(z) - 1 FROM stack WHERE w IN (0, 1)) AND y BETWEEN 1 AND 4 AND x BETWEEN 3 AND 6)
    SELECT a.image, round(covar_pop(a.v, b.v) / sqrt(var_pop(a.v) * var_pop(b.v)), 6) AS pearson FROM k a JOIN k b ON a.image = b.image AND a.z = b.z AND a.y = b.y AND a.x = b.x AND a.w = 0 AND b.w = 1 GROUP BY a.image"""
)
def pearson_in_common_box(spark, d):
    places = to_pixels(stack(spark, d)).where("w in (0, 1)").withColumn("image", F.explode(F.expr("sequence(0L, 2L)")))
    own = places.where("z >= 2 * image and x >= image and y <= 7 - image").withColumn("v", F.col("v") * (1 + F.col("image") * F.col("y")))
    return reduce.pearson_in_common(own, 2)


@query(
    """WITH b AS (SELECT label AS image, vec_id AS bead, CAST(embedding[1] AS DOUBLE) * 100 AS y, CAST(embedding[2] AS DOUBLE) * 100 AS x FROM embeddings)
    SELECT image, bead, y, x FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.image = b.image AND o.bead <> b.bead AND pow(o.y - b.y, 2) + pow(o.x - b.x, 2) < 16)"""
)
def beads_alone(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null")
    found = e.select(F.col("label").alias("image"), F.col("vec_id").alias("bead"), *[(F.get("embedding", F.lit(i)).cast("double") * 100).alias(c) for i, c in enumerate("yx")])
    return beads.alone(found, 4.0)


_BEADS_SQL = """f AS (SELECT vec_id AS bead, w, vec_id % 97 + CAST(embedding[w + 1] AS DOUBLE) AS y, vec_id * 7 % 89 + CAST(embedding[w + 4] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(3)) AS w)),
    o AS (SELECT a.bead, b.w, a.y * 80 AS y, a.x * 90 AS x, (b.y - a.y) * 80 AS dy, (b.x - a.x) * 90 AS dx FROM f a JOIN f b ON a.bead = b.bead AND a.w = 1 AND b.w <> 1),
    k AS (SELECT * FROM o WHERE bead NOT IN (SELECT bead FROM o WHERE greatest(abs(dy), abs(dx)) > 20 OR dy = 0 AND dx = 0))"""
_BEAD_VALUES = {"dy": "dy", "dx": "dx", "distance": "sqrt(dy * dy + dx * dx)"}


@query(
    f"""WITH {_BEADS_SQL} SELECT w, {', '.join(f'round(avg({e}), 6) AS {n}_mean, round(stddev_pop({e}), 6) AS {n}_std' for n, e in _BEAD_VALUES.items())},
    {', '.join(f'round(covar_pop(abs({c} - {m}), abs(d{c})) / sqrt(var_pop(abs({c} - {m})) * var_pop(abs(d{c}))), 6) AS pearson_{c}' for c, m in (('y', 3840), ('x', 3960)))}, count(*) AS n FROM k GROUP BY w"""
)
def bead_report(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null").withColumn("w", F.explode(F.expr("sequence(0L, 2L)")))
    n = lambda shift: F.get("embedding", (F.col("w") + shift).cast("int")).cast("double")
    found = e.select(F.lit(0).alias("image"), F.col("vec_id").alias("bead"), "w", (F.col("vec_id") % 97 + n(0)).alias("y"), (F.col("vec_id") * 7 % 89 + n(3)).alias("x"))
    return beads.report(beads.deviations(found, 1, (80.0, 90.0), 20.0), (3840.0, 3960.0))


_STEM = "'run_' || p_size || '_' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 1000 AS VARCHAR) END"
_LONG = f"'/data/' || {_STEM} || '.tif'"


@query(
    f"""SELECT p_partkey, {_STEM} || '.mrc' AS other, {_STEM} || '_cut.tif' AS suffixed, {_STEM} || '_cut.npy' AS both, regexp_extract({_STEM}, '[0-9]+$') AS number,
    regexp_replace({_STEM}, '[0-9]+$', '') || CASE WHEN regexp_matches({_STEM}, '[0-9]$') THEN lpad(CAST(CAST(regexp_extract({_STEM}, '[0-9]+$') AS BIGINT) + 1 AS VARCHAR), CAST(greatest(length(regexp_extract({_STEM}, '[0-9]+$')), length(CAST(CAST(regexp_extract({_STEM}, '[0-9]+$') AS BIGINT) + 1 AS VARCHAR))) AS INTEGER), '0') ELSE '0' END || '.tif' AS following,
    CASE WHEN length({_LONG}) > 20 THEN left({_LONG}, 8) || '...' || right({_LONG}, 9) ELSE {_LONG} END AS short FROM part"""
)
def file_names(spark, d):
    rows = table(spark, d, "part").withColumn("s", F.expr("concat('run_', p_size, '_', p_name, if(p_partkey % 3 = 0, '', cast(p_partkey % 1000 as string)), '.tif')"))
    s = F.col("s")
    return rows.select(
        "p_partkey", names.with_extension(s, "mrc").alias("other"), names.with_suffix(s, "_cut").alias("suffixed"), names.with_suffix(s, "_cut", ".npy").alias("both"),
        names.last_number(s).alias("number"), names.next_numbered(s).alias("following"), names.shortened(F.concat(F.lit("/data/"), s), 20).alias("short"),
    )


@query("SELECT p_partkey, CAST(p_partkey % 50 AS INT) AS z, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size END AS INT) AS t, CAST(p_partkey % 4 AS INT) AS w FROM part")
def series_places(spark, d):
    named = "concat('/x_z9/a', if(p_partkey % 2 = 0, concat('_T', lpad(p_size, 3, '0')), ''), '-z', p_partkey % 50, '_', if(p_size > 20, 'c', 'W'), p_partkey % 4, '.tif')"
    s = F.expr(named)
    return table(spark, d, "part").select("p_partkey", *[names.place_in_series(s, a).alias(a) for a in "ztw"])


@query("SELECT p_size AS token, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_size")
def name_groups(spark, d):
    s = F.expr("concat('/a_b/', p_size, '_', p_partkey, '.tif')")
    return table(spark, d, "part").groupBy(names.token(s).cast("int").alias("token")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS first, CAST(p_retailprice AS DOUBLE) AS last, '488:' || p_size || ' 561:' || CASE WHEN p_retailprice % 1 <> 0 THEN printf('%.2f', p_retailprice) ELSE CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) END AS again FROM part")
def channel_values(spark, d):
    rows = table(spark, d, "part").withColumn("m", text.number_map(F.concat(F.lit(" 488:"), "p_size", F.lit(", x, 561:7 561:"), "p_retailprice")))
    return rows.select("p_partkey", F.col("m")[F.lit(488.0)].alias("first"), F.col("m")[F.lit(561.0)].alias("last"), text.number_map_text(F.col("m")).alias("again"))
