"""Queries of filters, alignment, channels and peak lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from planecraft.functions import waves
from planecraft.operators import filters, fitting, kernels, region, registration, tile_loop, trials
from planecraft.plans.catalogue import _long, query
from planecraft.plans.model import pixels, sections, stack, table

_EACH = "SELECT vec_id AS z, label AS w, p // 8 AS y, p % 8 AS x, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, (SELECT unnest(range(64)) AS p)"


def _kept(planes):
    return _long(planes).withColumn("w", F.col("w").cast("int")).withColumn("v", F.round("v", 6) + 0.0)


@query(
    f"""WITH h AS (SELECT dy, dx, sum(exp(-(fy * fy + fx * fx) / (2 * pow(8 / (2 * pi() * 1.2), 2))) * cos(2 * pi() * (fy * dy + fx * dx) / 8)) / 64 AS h
      FROM (SELECT unnest(range(8)) AS dy), (SELECT unnest(range(8)) AS dx), (SELECT unnest(range(-4, 4)) AS fy), (SELECT unnest(range(-4, 4)) AS fx) GROUP BY dy, dx),
    k AS (SELECT list(h ORDER BY dy, dx) AS k FROM h)
    SELECT z, w, y, x, round(sum(e[q + 1] * k[((y - q // 8 + 8) % 8) * 8 + (x - q % 8 + 8) % 8 + 1]), 6) + 0.0 AS v FROM ({_EACH}), k, (SELECT unnest(range(64)) AS q) GROUP BY z, w, y, x"""
)
def low_pass_planes(spark, d):
    return _kept(filters.filtered(sections(spark, d), filters.low_pass, 1.2))


@query(f"SELECT z, w, y, x, round(e[((y - 3 + 8) % 8) * 8 + (x + 2) % 8 + 1], 6) + 0.0 AS v FROM ({_EACH})")
def fourier_shift_planes(spark, d):
    return _kept(filters.filtered(sections(spark, d), filters.shifted, 3, -2))


@query(f"""SELECT z, w, y, x, round(v(y - 1, x + 1) - v(y - 1, x - 1) + 2 * (v(y, x + 1) - v(y, x - 1)) + v(y + 1, x + 1) - v(y + 1, x - 1), 6) + 0.0 AS v FROM ({_EACH})""".replace("v(y - 1, ", "e[greatest(y - 1, 0) * 8 + 1 + ").replace("v(y + 1, ", "e[least(y + 1, 7) * 8 + 1 + ").replace("v(y, ", "e[y * 8 + 1 + ").replace("x + 1)", "least(x + 1, 7)]").replace("x - 1)", "greatest(x - 1, 0)]"))
def sobel_planes(spark, d):
    return _kept(filters.filtered(sections(spark, d), filters.sobel))


_AT = {"y": "(y - 3.5 - 0.5) / 1.1", "x": "(x - 3.5 + 0.25) / 0.9"}
_SRC = f"SELECT *, cos(radians(5)) * ({_AT['y']}) + sin(radians(5)) * ({_AT['x']}) + 3.5 AS sy, -sin(radians(5)) * ({_AT['y']}) + cos(radians(5)) * ({_AT['x']}) + 3.5 AS sx FROM ({_EACH})"
_CORNER = "CASE WHEN iy + {a} BETWEEN 0 AND 7 AND ix + {b} BETWEEN 0 AND 7 THEN e[(iy + {a}) * 8 + ix + {b} + 1] ELSE 0 END"
_BILINEAR = " + ".join(f"({'sy - iy' if a else '1 - sy + iy'}) * ({'sx - ix' if b else '1 - sx + ix'}) * {_CORNER.format(a=a, b=b)}" for a in (0, 1) for b in (0, 1))


_ROUND = f"SELECT *, 3.5 + y * sin(x * 2 * pi() / 12) AS sy, 3.5 + y * cos(x * 2 * pi() / 12) AS sx FROM (SELECT vec_id AS z, label AS w, y, x, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, (SELECT unnest(range(6)) AS y), (SELECT unnest(range(12)) AS x))"


@query(f"SELECT z, w, y, x, round({_BILINEAR}, 6) + 0.0 AS v FROM (SELECT *, CAST(floor(sy) AS BIGINT) AS iy, CAST(floor(sx) AS BIGINT) AS ix FROM ({_ROUND}))")
def polar_planes(spark, d):
    return _kept(filters.filtered(sections(spark, d), filters.polar, 6, 12))


@query(f"SELECT z, w, y, x, round({_BILINEAR}, 6) + 0.0 AS v FROM (SELECT *, CAST(floor(sy) AS BIGINT) AS iy, CAST(floor(sx) AS BIGINT) AS ix FROM ({_SRC}))")
def affine_apply(spark, d):
    return _kept(kernels.resampled(sections(spark, d), {"ty": 0.5, "tx": -0.25, "degrees": 5.0, "my": 1.1, "mx": 0.9}))


# coefficients by their closed form: sums of the values mirrored at both edges, with weights that fall by 2 - sqrt(3) a pixel
_MIRROR = "CASE WHEN abs({i}) % 14 > 7 THEN 14 - abs({i}) % 14 ELSE abs({i}) % 14 END"
_WEIGHT = "CASE WHEN abs({d}) < 1 THEN (4 - 6 * pow({d}, 2) + 3 * pow(abs({d}), 3)) / 6 WHEN abs({d}) < 2 THEN pow(2 - abs({d}), 3) / 6 ELSE 0 END"


@query(
    f"""WITH k AS (SELECT unnest(range(-30, 31)) AS k), m AS (SELECT i, j, sqrt(3) * sum(pow(sqrt(3) - 2, abs(k))) AS g FROM (SELECT unnest(range(8)) AS i), k, (SELECT unnest(range(8)) AS j) WHERE {_MIRROR.format(i='(i + k)')} = j GROUP BY i, j),
    f AS (SELECT z, w, y, x, e[y * 8 + x + 1] AS v FROM ({_EACH})), r AS (SELECT z, w, i AS y, x, sum(g * v) AS v FROM f JOIN m ON m.j = f.y GROUP BY z, w, i, x), c AS (SELECT z, w, y, i AS x, sum(g * v) AS c FROM r JOIN m ON m.j = r.x GROUP BY z, w, y, i),
    s AS (SELECT z, w, y, x, sy, sx, CAST(floor(sy) AS BIGINT) AS iy, CAST(floor(sx) AS BIGINT) AS ix FROM ({_SRC})),
    n AS (SELECT s.*, iy + a AS oy, ix + b AS ox FROM s, (SELECT unnest(range(-1, 3)) AS a), (SELECT unnest(range(-1, 3)) AS b) WHERE sy BETWEEN 0 AND 7 AND sx BETWEEN 0 AND 7)
    SELECT s.z, s.w, s.y, s.x, round(coalesce(any_value(v), 0), 6) + 0.0 AS v FROM s LEFT JOIN (
      SELECT n.z, n.w, n.y, n.x, sum(c * {_WEIGHT.format(d='(sy - oy)')} * {_WEIGHT.format(d='(sx - ox)')}) AS v FROM n JOIN c ON c.z = n.z AND c.w = n.w AND c.y = {_MIRROR.format(i='oy')} AND c.x = {_MIRROR.format(i='ox')} GROUP BY n.z, n.w, n.y, n.x) q
      ON q.z = s.z AND q.w = s.w AND q.y = s.y AND q.x = s.x GROUP BY s.z, s.w, s.y, s.x"""
)
def affine_cubic(spark, d):
    return _kept(kernels.resampled(sections(spark, d), {"ty": 0.5, "tx": -0.25, "degrees": 5.0, "my": 1.1, "mx": 0.9}, order=3))


@query(
    """WITH s AS (SELECT vec_id // 10 AS z, vec_id % 10 AS w, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT w, min(z) AS z0, max(z) AS z1 FROM s GROUP BY w),
    t AS (SELECT s.w, o.z AS up, e, 1 - abs(o.z - 0.25 - s.z) AS share FROM s JOIN n ON s.w = n.w JOIN (SELECT DISTINCT z FROM s) o ON abs(o.z - 0.25 - s.z) < 1 AND o.z BETWEEN n.z0 AND n.z1)
    SELECT up AS z, w, p // 8 AS y, p % 8 AS x, round(sum(e[p + 1] * share), 6) + 0.0 AS v FROM t, (SELECT unnest(range(64)) AS p) GROUP BY up, w, p"""
)
def shifted_in_z(spark, d):
    return _kept(registration.moved_in_z(stack(spark, d), 0.25)).withColumn("w", F.col("w").cast("long"))


def mosaics(spark, d):
    """Images of 64 x 64 pixels of 64 embeddings each, smoothed: (z, w, ny, nx, data)."""
    rows = sections(spark, d).select(F.floor(F.col("z") / 64).alias("m"), F.struct((F.col("z") % 64).alias("at"), "data").alias("s"))
    made = rows.groupBy("m").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["data"])).alias("data"))  # of 64 rows
    planes = made.where(F.size("data") == 4096).select(F.col("m").alias("z"), F.lit(0).alias("w"), F.lit(64).alias("ny"), F.lit(64).alias("nx"), "data")
    return filters.filtered(planes, filters.low_pass, 2.0)


@query()
def global_alignment(spark, d):
    """Of each mosaic, warped by a known map: what is found, rounded to tenths of a pixel."""
    planes = mosaics(spark, d)
    warped = kernels.resampled(planes, {"ty": 1.5, "tx": -2.0, "degrees": 0.6, "my": 1.0, "mx": 1.0})
    return registration.aligned(planes, warped.selectExpr("z", "data AS ref"))


@query()
def mosaic_peaks(spark, d):
    return fitting.peaks(mosaics(spark, d), 5, 0.0, 2.0, 9)


_WAVES = [405.0, 488.0, 561.0000000001, 640.0]


@query(
    f"""SELECT p_partkey, CASE WHEN n IN (405, 488, 640) THEN CASE n WHEN 405 THEN 0 WHEN 488 THEN 1 ELSE 3 END WHEN n = 561 THEN 2 WHEN n < 4 THEN n END::BIGINT AS place,
    CASE WHEN m IN (405.0, 488.0, 640.0) THEN m ELSE CASE m WHEN 0 THEN 405.0 WHEN 1 THEN 488.0 WHEN 2 THEN 561.0000000001 WHEN 3 THEN 640.0 END END::DOUBLE AS wave
    FROM (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 405 WHEN 1 THEN 488 WHEN 2 THEN 561 WHEN 3 THEN 640 WHEN 4 THEN 2 WHEN 5 THEN 0 ELSE 700 END AS n, CASE p_size % 7 WHEN 0 THEN 405 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 640 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 9 END AS m FROM part)"""
)
def wave_places(spark, d):
    by = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("p_size") % 7).cast("int"))
    return table(spark, d, "part").select("p_partkey", waves.place(by(405, 488, 561, 640, 2, 0, 700), _WAVES).alias("place"), waves.of(by(405, 0, 2, 640, 3, 1, 9), _WAVES).alias("wave"))


def _channels(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("image"), F.floor(F.col("c_acctbal") / 1000).alias("wave"))


_CHANNELS = "SELECT c_nationkey AS image, CAST(floor(c_acctbal / 1000) AS BIGINT) AS wave FROM customer"


@query(f"WITH c AS ({_CHANNELS}) SELECT image FROM c WHERE wave <> 0 GROUP BY image HAVING count(*) > count(DISTINCT wave)")
def repeated_waves(spark, d):
    return waves.repeated(_channels(spark, d))


@query(f"WITH c AS ({_CHANNELS}) SELECT image, count(*) FILTER (wave IN (SELECT wave FROM c WHERE image = 3)) AS n FROM c GROUP BY image HAVING count(*) FILTER (wave IN (SELECT wave FROM c WHERE image = 3)) < 8")
def unmatched_waves(spark, d):
    return waves.unmatched(_channels(spark, d), 3, 8)


@query("SELECT vec_id AS z, label + 10 * k AS w, CAST(embedding AS DOUBLE[]) AS data FROM embeddings, (SELECT unnest(range(2)) AS k)")
def merge_along_w(spark, d):
    s = sections(spark, d)
    return region.merged_along_w([s, s], 10).select("z", F.col("w").cast("long").alias("w"), "data")


@query("SELECT z, w, data FROM (SELECT vec_id AS z, label - (SELECT count(*) FROM (SELECT unnest([2, 5]) AS gone) WHERE gone < label) AS w, CAST(embedding AS DOUBLE[]) AS data FROM embeddings WHERE label NOT IN (2, 5))")
def drop_empty_channels(spark, d):
    dark = sections(spark, d).withColumn("data", F.when(F.col("w").isin(2, 5), F.transform("data", lambda v: F.lit(0.0))).otherwise(F.col("data")))
    return region.without_empty_channels(dark).select("z", F.col("w").cast("long").alias("w"), "data")


@query("SELECT y AS z, w, vec_id AS y, x, v FROM (SELECT vec_id, label AS w, p // 8 AS y, p % 8 AS x, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS p))")
def view_xz(spark, d):
    return region.axes(pixels(spark, d), "xz").select("z", "w", "y", "x", "v")



_TRUTH = {"ty": 1.5, "tx": -2.0, "r": 0.6, "my": 1.0, "mx": 1.0}


@query()
def registration_report(spark, d):
    """Mosaics against themselves mapped, under noise in two steps, by two methods: what is found, and how far off it is."""
    bright = mosaics(spark, d).withColumn("data", F.transform("data", lambda v: v * 1000))
    return trials.compared(bright, _TRUTH, [1, 4], 1.0, ("quadrants", "shift"))


@query()
def tile_loop_shifts(spark, d):
    """Mosaics against themselves shifted, from tiles of 32 pixels down to 16."""
    planes = mosaics(spark, d)
    moved = kernels.resampled(planes, {"ty": 1.5, "tx": -2.0, "degrees": 0.0, "my": 1.0, "mx": 1.0})
    return tile_loop.refined(planes, moved, 64, 64, tile_loop.Loop(least_window=16))[0]
