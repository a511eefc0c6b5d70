"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planecraft.functions import text
from planecraft.operators import histogram, kernels, params, plane, reduce, region
from planecraft.plans.storage import checked
from planecraft.plans.model import PIXELS_SQL, STACK_SQL, pixels, sections, stack, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "channel_mmms"
WAVES = [(0, 400.2), (1, 488.4), (2, 561.0), (3, 640.0), (4, 700.0)]
PARAM_WAVES = [(0, 488.0), (1, 560.9), (2, 639.7)]
WELLS = [(i, (i + d) % 8) for i in range(8) for d in (1, 7)]


def query(sql: str | None = None, pixel_sql: str | None = None):
    """Register a query, with SQL over the tables or over `pixels` (z, w, y, x, v)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql or pixel_sql:
            ORACLES[f.__name__] = sql or f"WITH {PIXELS_SQL} {pixel_sql}"
        return f

    return add


@query(pixel_sql="SELECT w, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std FROM pixels GROUP BY w")
def channel_mmms(spark, d):
    return reduce.mmms(pixels(spark, d), "w")


@query(pixel_sql="SELECT z, w, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std FROM pixels GROUP BY z, w")
def section_mmms(spark, d):
    return reduce.section_mmms(sections(spark, d))


@query(pixel_sql=", c AS (SELECT w, median(v) AS m FROM pixels GROUP BY w) SELECT w, round(any_value(m), 6) AS v_median, round(median(abs(v - m)), 6) AS v_mad FROM pixels JOIN c USING (w) GROUP BY w")
def median_mad(spark, d):
    return reduce.median_mad(pixels(spark, d), "w")


@query(pixel_sql="SELECT w, quantile_disc(v, 0.99) AS v_top FROM pixels GROUP BY w")
def top_percentile(spark, d):
    return reduce.percentile(pixels(spark, d), 0.99, "w")


@query(pixel_sql="SELECT w, v, z, y, x FROM pixels QUALIFY row_number() OVER (PARTITION BY w ORDER BY v DESC, z, y, x) = 1")
def argmax_first(spark, d):
    return reduce.argmax(pixels(spark, d), "w")


@query(pixel_sql="SELECT w, y, x, max(v) AS v FROM pixels GROUP BY w, y, x")
def max_projection(spark, d):
    return reduce.projection(pixels(spark, d), "w")


@query(pixel_sql="SELECT w, round(avg(v), 6) AS v_mean FROM pixels GROUP BY w ORDER BY avg(v) DESC, w LIMIT 1")
def best_channel(spark, d):
    return reduce.best(pixels(spark, d), "w")


@query("SELECT CAST(ts AS DATE) AS frame, round(avg(value), 6) AS v_mean FROM events GROUP BY 1 ORDER BY avg(value) DESC, frame LIMIT 1")
def best_frame(spark, d):
    return reduce.best(table(spark, d, "events").select(F.to_date("ts").alias("frame"), "value"), "frame", "value")


@query(f"WITH {STACK_SQL}, r AS (SELECT z, y, x, v AS r FROM stack WHERE w = 0) SELECT w, round(covar_pop(v, r) / nullif(sqrt(var_pop(v) * var_pop(r)), 0), 6) AS pearson FROM stack JOIN r USING (z, y, x) GROUP BY w")
def pearson_vs_reference(spark, d):
    return reduce.pearson(stack(spark, d), 0)


@query(pixel_sql="SELECT w, round(sum((v + 1) * y) / sum(v + 1), 6) AS cy, round(sum((v + 1) * x) / sum(v + 1), 6) AS cx FROM pixels GROUP BY w")
def centroid(spark, d):
    return reduce.centroid(pixels(spark, d), "w")


@query(pixel_sql="SELECT w, CAST(floor(sqrt((y - 4) * (y - 4) + (x - 4) * (x - 4))) AS BIGINT) AS r, round(avg(v), 6) AS v_mean, count(*) AS n FROM pixels GROUP BY 1, 2")
def radial_average(spark, d):
    return reduce.radial_average(pixels(spark, d), 4, 4, "w")


@query(pixel_sql="SELECT w, z, round(avg(v), 6) AS v_mean FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY w, z")
def z_profile(spark, d):
    return reduce.z_profile(pixels(spark, d), (2, 5), (2, 5))


@query(
    pixel_sql=""", s AS (SELECT step, CAST(floor(1 + step * (5 / sqrt(61.0)) + 0.5) AS BIGINT) AS y, CAST(floor(1 + step * (6 / sqrt(61.0)) + 0.5) AS BIGINT) AS x FROM (SELECT unnest(range(8)) AS step))
    SELECT z, w, step, round(v, 6) AS v FROM s JOIN pixels USING (y, x)"""
)
def line_profile(spark, d):
    return reduce.line_profile(sections(spark, d), (1, 1), (6, 7)).withColumn("v", F.round("v", 6))


def _hist_sql(bins: int) -> str:
    return f""", l AS (SELECT w, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY w),
    h AS (SELECT w, CAST(coalesce(floor((v - lo) / nullif((hi - lo) / {bins - 1}, 0)), 0) AS BIGINT) AS bin, count(*) AS n, round(sum(v), 6) AS weight, any_value(lo) AS lo, any_value(hi) AS hi
          FROM pixels JOIN l USING (w) GROUP BY 1, 2)"""


@query(pixel_sql=_hist_sql(16) + " SELECT * FROM h")
def histogram16(spark, d):
    return histogram.histogram(pixels(spark, d), 16, "w")


@query(pixel_sql=_hist_sql(64) + " SELECT w, bin, n, sum(n) OVER (PARTITION BY w ORDER BY bin) / sum(n) OVER (PARTITION BY w) AS share FROM h")
def hist_equalize(spark, d):
    return histogram.equalised(histogram.histogram(pixels(spark, d), 64, "w"), "w")


@query(
    pixel_sql=_hist_sql(64)
    + """, c AS (SELECT w, bin, sum(n) OVER u AS n0, sum(n * bin) OVER u AS s0, sum(n) OVER a AS nt, sum(n * bin) OVER a AS st FROM h
      WINDOW u AS (PARTITION BY w ORDER BY bin), a AS (PARTITION BY w)),
    b AS (SELECT w, bin, round((n0 * (nt - n0)) / CAST(nt * nt AS DOUBLE) * (s0 / n0 - (st - s0) / (nt - n0)) * (s0 / n0 - (st - s0) / (nt - n0)), 6) AS bv FROM c WHERE nt > n0)
    SELECT w, bin AS threshold_bin, bv AS between_variance FROM b QUALIFY row_number() OVER (PARTITION BY w ORDER BY bv DESC, bin) = 1"""
)
def otsu(spark, d):
    return histogram.otsu(histogram.histogram(pixels(spark, d), 64, "w"), "w")


@query(
    pixel_sql=_hist_sql(64)
    + """, c AS (SELECT w, bin, CAST(sum(n) OVER u AS DOUBLE) AS n, CAST(sum(n * bin) OVER u AS DOUBLE) AS s, CAST(sum(n) OVER a AS DOUBLE) AS nt, CAST(sum(n * bin) OVER a AS DOUBLE) AS st FROM h
      WINDOW u AS (PARTITION BY w ORDER BY bin), a AS (PARTITION BY w)),
    p AS (SELECT x.w, x.bin, y.bin AS bin2, round((x.s * x.s / x.n + (y.s - x.s) * (y.s - x.s) / (y.n - x.n) + (x.st - y.s) * (x.st - y.s) / (x.nt - y.n)) / x.nt - (x.st / x.nt) * (x.st / x.nt), 6) AS v
      FROM c x JOIN c y ON x.w = y.w AND x.bin < y.bin WHERE y.n < y.nt)
    SELECT w, bin AS threshold1_bin, bin2 AS threshold2_bin, v AS between_variance FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY v DESC, bin, bin2) = 1"""
)
def otsu2(spark, d):
    return histogram.otsu2(histogram.histogram(pixels(spark, d), 64, "w"), "w")


_basic_sql = (
    _hist_sql(64)
    + """, e AS (SELECT w, lo, hi, lo + bin * (hi - lo) / 63 AS x, n FROM h),
    it AS (SELECT w, 0 AS i, (lo + hi) * 0.5 AS t, false AS done FROM l
      UNION ALL
      SELECT w, i + 1, m, abs(m - t) < 0.0001 FROM (
        SELECT it.w, it.i, it.t, 0.5 * (sum(n * x) FILTER (x <= t) / sum(n) FILTER (x <= t) + sum(n * x) FILTER (x > t) / sum(n) FILTER (x > t)) AS m
        FROM it JOIN e ON it.w = e.w WHERE NOT done AND i < 100 GROUP BY it.w, it.i, it.t)),
    t AS (SELECT w, round(t, 6) AS threshold FROM it QUALIFY row_number() OVER (PARTITION BY w ORDER BY i DESC) = 1)
    SELECT w, threshold, count(*) FILTER (v > threshold) AS n_above FROM pixels JOIN t USING (w) GROUP BY w, threshold"""
)


@query(f"WITH RECURSIVE {PIXELS_SQL} {_basic_sql}")
def threshold_basic(spark, d):
    limits = histogram.basic_threshold(histogram.histogram(pixels(spark, d), 64, "w"), 64, "w", dt=0.0001)
    return histogram.above(pixels(spark, d), limits, "w")


@query(
    pixel_sql=_hist_sql(12)
    + """, c AS (SELECT w, bin, CAST(sum(n) OVER u AS DOUBLE) AS n, CAST(sum(n * bin) OVER u AS DOUBLE) AS s, CAST(sum(n) OVER a AS DOUBLE) AS nt, CAST(sum(n * bin) OVER a AS DOUBLE) AS st FROM h
      WINDOW u AS (PARTITION BY w ORDER BY bin), a AS (PARTITION BY w)),
    p AS (SELECT x.w, x.bin, y.bin AS bin2, z.bin AS bin3, round((x.s * x.s / x.n + (y.s - x.s) * (y.s - x.s) / (y.n - x.n) + (z.s - y.s) * (z.s - y.s) / (z.n - y.n) + (x.st - z.s) * (x.st - z.s) / (x.nt - z.n)) / x.nt - (x.st / x.nt) * (x.st / x.nt), 6) AS v
      FROM c x JOIN c y ON x.w = y.w AND x.bin < y.bin JOIN c z ON y.w = z.w AND y.bin < z.bin WHERE z.n < z.nt)
    SELECT w, bin AS threshold1_bin, bin2 AS threshold2_bin, bin3 AS threshold3_bin, v AS between_variance FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY v DESC, bin, bin2, bin3) = 1"""
)
def otsu3(spark, d):
    return histogram.otsu3(histogram.histogram(pixels(spark, d), 12, "w"), "w")


@query(
    pixel_sql=_hist_sql(64)
    + """, c AS (SELECT w, bin, sum(n) OVER (PARTITION BY w ORDER BY bin) / sum(n) OVER (PARTITION BY w) AS share FROM h),
    q AS (SELECT z, w, y, x, coalesce(floor((v - lo) * 63 / nullif(hi - lo, 0) + 0.5), 0) AS b FROM pixels JOIN l USING (w))
    SELECT z, q.w, y, x, share AS v FROM q ASOF JOIN c ON q.w = c.w AND q.b >= c.bin"""
)
def hist_equalized_stack(spark, d):
    p = pixels(spark, d)
    return histogram.equalised_values(p, histogram.histogram(p, 64, "w"), 64, "w")


def _plane_sql(select: str) -> str:
    return f" SELECT z, w, y, x, round({select}, 6) AS v FROM pixels WINDOW r AS (PARTITION BY z, w, y ORDER BY x)"


def _long(planes: DataFrame) -> DataFrame:
    p = planes.select("z", "w", "nx", F.posexplode("data").alias("p", "v"))
    return p.select("z", "w", F.expr("cast(p div nx as bigint)").alias("y"), F.expr("cast(p % nx as bigint)").alias("x"), "v")


@query(pixel_sql=" SELECT z, w, y // 2 AS y, x // 2 AS x, round(sum(v), 6) AS v FROM pixels GROUP BY z, w, y // 2, x // 2")
def binning_2x2(spark, d):
    return _long(plane.binned(sections(spark, d), 2))


def _smooth_sql(weights: list[str]) -> str:
    """Rows continued at both ends as s(-k) = 2 x(0) - x(k + 1) and s(7 + k) = 2 x(7) - x(8 - k), then weighted."""
    half = len(weights) // 2
    terms = " + ".join(f"{w} * s.v[{half + 1} + e.x + {j - half}]" for j, w in enumerate(weights))
    ends = [f"2 * r[1] - r[{k + 2}]" for k in range(half, 0, -1)], [f"2 * r[8] - r[{9 - k}]" for k in range(1, half + 1)]
    return f""", r AS (SELECT z, w, y, list(v ORDER BY x) AS r FROM pixels GROUP BY z, w, y),
    s AS (SELECT z, w, y, list_concat([{", ".join(ends[0])}], r, [{", ".join(ends[1])}]) AS v FROM r)
    SELECT s.z, s.w, s.y, e.x, round({terms}, 6) AS v FROM s, (SELECT unnest(range(8)) AS x) e"""


@query(pixel_sql=_smooth_sql(["(1.0 / 3)"] * 3))
def smooth_flat3(spark, d):
    return _long(plane.smoothed(sections(spark, d), 3))


@query(pixel_sql=_smooth_sql(["0.0", "0.25", "0.5", "0.25", "0.0"]))
def smooth_hanning5(spark, d):
    return _long(plane.smoothed(sections(spark, d), 5, "hanning"))


@query(pixel_sql=_plane_sql("CASE WHEN x > 0 THEN v - lag(v) OVER r ELSE 0 END"))
def derivative(spark, d):
    return _long(plane.derivative(sections(spark, d)))


@query(
    """SELECT vec_id AS z, label AS w, y, x, round(0.375 * e[y * 8 + x + 1] + 0.375 * CASE WHEN x < 7 THEN e[y * 8 + x + 2] ELSE 0 END + 0.125 * CASE WHEN y < 7 THEN e[y * 8 + x + 9] ELSE 0 END
      + 0.125 * CASE WHEN y < 7 AND x < 7 THEN e[y * 8 + x + 10] ELSE 0 END, 6) AS v
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), (SELECT p // 8 AS y, p % 8 AS x FROM (SELECT unnest(range(64)) AS p))"""
)
def bilinear_shift(spark, d):
    return _long(plane.shifted(sections(spark, d), 0.25, 0.5))


@query(pixel_sql=" SELECT w, round(covar_pop(x, v) / var_pop(x), 6) AS slope, round(avg(v) - covar_pop(x, v) / var_pop(x) * avg(x), 6) AS intercept FROM pixels GROUP BY w")
def fit_line(spark, d):
    return plane.fit_line(pixels(spark, d), "w")


@query(pixel_sql=""", s AS (SELECT * FROM pixels WHERE v >= 0.15) SELECT a.z, a.w, count(*) AS n_pairs FROM s a JOIN s b
  ON a.z = b.z AND a.w = b.w AND (b.y > a.y OR b.y = a.y AND b.x > a.x) AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 5.827396 GROUP BY a.z, a.w""")
def saturation_pairs(spark, d):
    return plane.close_pairs(pixels(spark, d), 0.15)


def parameters(spark, d) -> DataFrame:
    """Parameter rows of frames of ten channels, from the first numbers of each embedding."""
    e = table(spark, d, "embeddings")
    n = lambda i: F.col("embedding")[i].cast("double")
    return e.select(F.floor(F.col("vec_id") / 10).alias("t"), (F.col("vec_id") % 10).alias("w"), *[(n(i) * 10).alias(c) for i, c in enumerate(params.SHIFTS)], *[(1 + n(i + 4) / 10).alias(c) for i, c in enumerate(params.ZOOMS)])


PARAMS_SQL = "params AS (SELECT vec_id // 10 AS t, vec_id % 10 AS w, " + ", ".join([f"CAST(embedding[{i + 1}] AS DOUBLE) * 10 AS {c}" for i, c in enumerate(params.SHIFTS)] + [f"1 + CAST(embedding[{i + 5}] AS DOUBLE) / 10 AS {c}" for i, c in enumerate(params.ZOOMS)]) + " FROM embeddings)"
_rebased = ", ".join([f"a.{c} - b.{c} AS {c}" for c in params.SHIFTS] + [f"a.{c} / b.{c} AS {c}" for c in params.ZOOMS])
REBASED_SQL = f"rebased AS (SELECT t, w, {', '.join(f'round({c}, 6) AS {c}' for c in params.NAMES)} FROM (SELECT a.t, a.w, {_rebased} FROM params a JOIN params b ON a.t = b.t AND b.w = 0))"


@query(f"WITH {PARAMS_SQL}, {REBASED_SQL} SELECT * FROM rebased")
def param_rebase(spark, d):
    return params.rebased(parameters(spark, d), 0)


@query(f"WITH {PARAMS_SQL} SELECT t, w, {', '.join([f'round(-{c}, 6) AS {c}' for c in params.SHIFTS] + [f'round(1 / {c}, 6) AS {c}' for c in params.ZOOMS])} FROM params")
def param_flip(spark, d):
    return params.inverted(parameters(spark, d))


@query(f"WITH {PARAMS_SQL}, {REBASED_SQL} SELECT w, {', '.join(f'round(avg({c}), 4) AS {c}' for c in params.NAMES)} FROM rebased GROUP BY w")
def param_average(spark, d):
    return params.averaged(parameters(spark, d), 0)


_nm = {"tz": "tz * 200", "ty": "ty * 80", "tx": "tx * 80", "r": "2 * sin(radians(abs(r)) / 2) * sqrt(256 * 256 + 256 * 256) * 80", "mz": "abs(mz * 16 - 16) * 200", "my": "abs(my * 256 - 256) * 80", "mx": "abs(mx * 256 - 256) * 80"}


@query(f"WITH {PARAMS_SQL} SELECT t, w, {', '.join(f'round({e}, 4) AS {c}' for c, e in _nm.items())}, round(sqrt({' + '.join(f'({e}) * ({e})' for e in _nm.values())}), 4) AS total FROM params")
def param_nm_summary(spark, d):
    return params.in_nanometres(parameters(spark, d), (0.2, 0.08, 0.08), (16, 256, 256))


def _values(rows) -> str:
    return ", ".join(str(r) for r in rows)


@query(
    f"""WITH {PARAMS_SQL}, tw(target, wave) AS (VALUES {_values(WAVES)}), pw(w, wave) AS (VALUES {_values(PARAM_WAVES)}),
    own AS (SELECT CAST(round(pw.wave) AS INT) AS k, params.* FROM params JOIN pw ON params.w = pw.w),
    frames AS (SELECT DISTINCT t FROM own)
    SELECT f.t, tw.target, CAST(tw.wave AS DOUBLE) AS wave, {', '.join(f'coalesce(o.{c}, r.{c}) AS {c}' for c in params.NAMES)}
    FROM frames f CROSS JOIN tw LEFT JOIN own o ON o.t = f.t AND o.k = CAST(round(tw.wave) AS INT) LEFT JOIN own r ON r.t = f.t AND r.k = 488"""
)
def wave_matched_params(spark, d):
    own = parameters(spark, d).join(F.broadcast(spark.createDataFrame(PARAM_WAVES, "w long, wave double")), "w")  # a row for each channel
    return params.matched(spark.createDataFrame(WAVES, "target int, wave double"), own, 488.0)


@query(f"WITH {PARAMS_SQL} SELECT t, CAST(max(ceil(greatest(ty, 0))) AS BIGINT) AS y0, CAST(min(floor(512 + least(ty, 0))) AS BIGINT) AS y1, CAST(max(ceil(greatest(tx, 0))) AS BIGINT) AS x0, CAST(min(floor(512 + least(tx, 0))) AS BIGINT) AS x1 FROM params GROUP BY t")
def crop_box(spark, d):
    return params.crop_box(parameters(spark, d), 512, 512)


GAIN_SQL = ", s AS (SELECT w, y, x, avg(v + 1) AS spot FROM pixels GROUP BY w, y, x), m AS (SELECT w, avg(spot) AS m FROM s GROUP BY w), gain AS (SELECT w, y, x, round(m / spot, 6) AS gain FROM s JOIN m USING (w))"


@query(pixel_sql=GAIN_SQL + " SELECT * FROM gain")
def flat_gain(spark, d):
    return params.flat_gain(pixels(spark, d))


@query(pixel_sql=GAIN_SQL + " SELECT z, w, round(sum((v + 1) * coalesce(gain, 1)), 4) AS total FROM pixels LEFT JOIN gain USING (w, y, x) GROUP BY z, w")
def flat_apply(spark, d):
    return params.flat_applied(pixels(spark, d), params.flat_gain(pixels(spark, d)))


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{e}'), 6) AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def spectrum_pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.avg("value"), 6))


_apart = {c: f"(b.{c} - a.{c})" for c in params.NAMES}
_wells_nm = {
    "tz": f"{_apart['tz']} * 200",
    "ty": f"{_apart['ty']} * 80",
    "tx": f"{_apart['tx']} * 80",
    # the way of the centre (y, x) = (256, 256) when it is rotated about the origin
    "r": f"sqrt(pow(256 * cos(radians({_apart['r']})) + 256 * sin(radians({_apart['r']})) - 256, 2) + pow(256 * cos(radians({_apart['r']})) - 256 * sin(radians({_apart['r']})) - 256, 2)) * 80",
    "mz": f"abs(16 * (1 + {_apart['mz']}) - 16) * 200",
    "my": f"abs(256 * (1 + {_apart['my']}) - 256) * 80",
    "mx": f"abs(256 * (1 + {_apart['mx']}) - 256) * 80",
}


@query(f"WITH {PARAMS_SQL}, edges(src, dst) AS (VALUES {_values(WELLS)}) SELECT a.t, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, {', '.join(f'round({e}, 4) AS {c}' for c, e in _wells_nm.items())}, round(sqrt({' + '.join(f'pow({e}, 2)' for e in _wells_nm.values())}), 4) AS total FROM edges JOIN params a ON a.w = src JOIN params b ON b.w = dst AND a.t = b.t")
def well_neighbors(spark, d):
    edges = F.broadcast(spark.createDataFrame(WELLS, "src long, dst long"))  # sixteen rows
    return params.neighbours(parameters(spark, d), edges, (200.0, 80.0, 80.0), (16.0, 256.0, 256.0))


@query("SELECT vec_id AS z, label AS w, t, CAST(embedding AS DOUBLE[]) AS data FROM embeddings, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS v(t)")
def merge_along_t(spark, d):
    s = sections(spark, d)
    return region.merged_along_t([s, s]).select("z", "w", "t", "data")


@query("SELECT vec_id AS z, label AS w, CAST(embedding AS DOUBLE[]) AS data FROM embeddings WHERE label IN (1, 3) AND vec_id BETWEEN 10 AND 200")
def copy_region(spark, d):
    return region.copied(sections(spark, d), [1, 3], (10, 200)).select("z", "w", "data")


@query("SELECT CAST(0 AS BIGINT) AS z, vec_id AS t, label AS w, CAST(embedding AS DOUBLE[]) AS data FROM embeddings")
def swap_z_t(spark, d):
    return region.swapped(sections(spark, d).withColumn("t", F.lit(0).cast("long")), "z", "t").select("z", "t", "w", "data")


_dark = "CASE WHEN v > 0.3 THEN v ELSE 0 END"


@query(pixel_sql=f", dark AS (SELECT z AS w, {_dark} AS v FROM pixels) SELECT w FROM dark GROUP BY w HAVING min(v) = 0 AND max(v) = 0")
def empty_channels(spark, d):
    dark = sections(spark, d).select(F.col("z").alias("w"), F.transform("data", lambda v: F.when(v > 0.3, v).otherwise(0.0)).alias("data"))
    return region.empty_channels(dark)


@query("SELECT p_partkey, list_sort(list_distinct([p_size, p_size + 1, p_size + 2, 7])) AS numbers FROM part")
def number_seq(spark, d):
    listed = F.concat("p_size", F.lit("-"), F.col("p_size") + 2, F.lit(", 7, x"))
    return table(spark, d, "part").select("p_partkey", text.number_list(listed).alias("numbers"))


@query("SELECT p_partkey, translate(p_type, 'AEIOU', 'aeiou') AS p_type FROM part")
def translate_letters(spark, d):
    return table(spark, d, "part").select("p_partkey", text.swapped_letters(F.col("p_type"), "AEIOU", "aeiou").alias("p_type"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '[0-9]{3}\\.[0-9]{3}')")
def grep(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(r"[0-9]{3}\.[0-9]{3}")).select("doc_id", F.length("text").cast("long").alias("n"))


@query()
def phase_correlation(spark, d):
    planes = sections(spark, d)
    ref = checked(planes.groupBy("w").agg(F.min_by("data", "z").alias("ref")), "references", 1000)
    return kernels.correlated(planes, ref)


from planecraft.plans import grids, images, series, shapes, stacks, tables  # noqa: E402, F401  (they register their queries)
