"""Queries of measures, plane operations, made stacks, coordinates, optics and numbers; their SQL is written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from planecraft.functions import curves, geometry, numbers, optics
from planecraft.operators import generated, measure, plane
from planecraft.plans.catalogue import _hist_sql, _long, query
from planecraft.plans.model import pixels, sections, table


def _rounded(**values) -> list:
    return [F.round(v, 6).alias(n) for n, v in values.items()]


def _sql(**values: str) -> str:
    return ", ".join(f"round({v}, 6) AS {n}" for n, v in values.items())


# measures


@query(pixel_sql="SELECT w, round(sum(abs(v)), 6) AS l1, round(sqrt(sum(v * v)), 6) AS l2, round(sqrt(avg(v * v)), 6) AS rms FROM pixels GROUP BY w")
def norms(spark, d):
    return measure.norms(pixels(spark, d), "w")


@query(pixel_sql="SELECT w, round(stddev_pop(v) * 2 * sqrt(2 * ln(2)), 6) AS fwhm FROM pixels GROUP BY w")
def half_width(spark, d):
    return measure.half_width(pixels(spark, d), "w")


@query(pixel_sql=", m AS (SELECT w, avg(v) AS m, max(v) AS top FROM pixels GROUP BY w), s AS (SELECT w, any_value(m) AS m, any_value(top) AS top, sqrt(pow(avg(v) FILTER (v < m) - any_value(m), 2) * pi() * 0.5) AS sigma FROM pixels JOIN m USING (w) GROUP BY w) SELECT w, round(sigma, 6) AS noise_sigma, round((top - m) / nullif(sigma, 0), 6) AS signal_to_noise FROM s")
def noise(spark, d):
    return measure.noise(pixels(spark, d), "w")


@query(pixel_sql="SELECT w, v, z, y, x FROM pixels QUALIFY row_number() OVER (PARTITION BY w ORDER BY v, z, y, x) = 1")
def argmin_first(spark, d):
    return measure.argmin(pixels(spark, d), "w")


@query(
    pixel_sql=""", q AS (SELECT w, (y // 4) * 2 + x // 4 AS label, z, y, x, v + 1 AS v FROM pixels WHERE (y // 4) * 2 + x // 4 > 0),
    t AS (SELECT w, label, z, y, x FROM q QUALIFY row_number() OVER (PARTITION BY w, label ORDER BY v DESC, z, y, x) = 1),
    b AS (SELECT w, label, z, y, x FROM q QUALIFY row_number() OVER (PARTITION BY w, label ORDER BY v, z, y, x) = 1),
    s AS (SELECT w, label, round(sum(v), 6) AS total, round(avg(v), 6) AS v_mean, round(sum(v * y) / sum(v), 6) AS cy, round(sum(v * x) / sum(v), 6) AS cx FROM q GROUP BY w, label)
    SELECT s.w, s.label, total, v_mean, t.z AS max_z, t.y AS max_y, t.x AS max_x, b.z AS min_z, b.y AS min_y, b.x AS min_x, cy, cx FROM s JOIN t ON s.w = t.w AND s.label = t.label JOIN b ON s.w = b.w AND s.label = b.label"""
)
def labelled_regions(spark, d):
    quarters = F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)
    return measure.labelled(pixels(spark, d).withColumn("label", quarters).withColumn("v", F.col("v") + 1), "w")


@query(
    pixel_sql=""", l AS (SELECT w, min(v) AS lo, max(v) AS hi, count(*) AS n FROM pixels GROUP BY w),
    b AS (SELECT w, CAST(least(floor((v - lo) / ((hi - lo) / n)), n - 1) AS BIGINT) AS bin, count(*) AS held, any_value(lo) AS lo, any_value((hi - lo) / n) AS width FROM pixels JOIN l USING (w) GROUP BY 1, 2)
    SELECT w, round(lo + bin * width, 6) AS mode, held FROM b QUALIFY row_number() OVER (PARTITION BY w ORDER BY held DESC, bin DESC) = 1"""
)
def mode(spark, d):
    return measure.mode(pixels(spark, d), "w")


@query(pixel_sql=_hist_sql(40) + ", e AS (SELECT w, lo, hi, unnest(range(40)) AS bin FROM l) SELECT e.w, e.bin, round(e.lo + e.bin * (e.hi - e.lo) / 39, 6) AS x, coalesce(h.n, 0) AS n FROM e LEFT JOIN h ON e.w = h.w AND e.bin = h.bin")
def histogram_places(spark, d):
    from planecraft.operators import histogram

    return measure.histogram_places(histogram.histogram(pixels(spark, d), 40, "w"), 40, "w")


@query(pixel_sql="SELECT w, z, x, max(v) AS v FROM pixels GROUP BY w, z, x")
def projection_along_y(spark, d):
    return measure.projection(pixels(spark, d), "y", "w")


@query(
    pixel_sql=""", f AS (SELECT w, covar_pop(x, v) / var_pop(x) AS a, avg(v) - covar_pop(x, v) / var_pop(x) * avg(x) AS b FROM pixels GROUP BY w)
    SELECT w, round(any_value(a), 6) AS slope, round(any_value(b), 6) AS intercept, round(sqrt(sum(pow(a * x + b - v, 2))) / count(*), 6) AS rest FROM pixels JOIN f USING (w) GROUP BY w"""
)
def line_fit(spark, d):
    return measure.line_fit(pixels(spark, d), "w")


@query(
    pixel_sql=""", s AS (SELECT w, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS a, CAST(sum(x * x) AS DOUBLE) AS b, CAST(sum(x * x * x) AS DOUBLE) AS c, CAST(sum(x * x * x * x) AS DOUBLE) AS e, sum(v) AS p, sum(x * v) AS q, sum(x * x * v) AS r FROM pixels GROUP BY w),
    t AS (SELECT *, n * (b * e - c * c) - a * (a * e - b * c) + b * (a * c - b * b) AS det FROM s)
    SELECT w, round((p * (b * e - c * c) - a * (q * e - c * r) + b * (q * c - b * r)) / det, 6) AS c0,
      round((n * (q * e - c * r) - p * (a * e - b * c) + b * (a * r - q * b)) / det, 6) AS c1,
      round((n * (b * r - q * c) - a * (a * r - q * b) + p * (a * c - b * b)) / det, 6) AS c2 FROM t"""
)
def parabola_fit(spark, d):
    return measure.parabola_fit(pixels(spark, d), "w")


@query(
    """SELECT vec_id AS z, k, round(sqrt(re * re + im * im), 6) AS size, round(atan2(im, re), 6) AS angle, round(re, 6) AS re, round(im, 6) AS im
    FROM (SELECT vec_id, k, CAST(embedding[2 * k + 1] AS DOUBLE) AS re, CAST(embedding[2 * k + 2] AS DOUBLE) AS im FROM embeddings, (SELECT unnest(range(32)) AS k))"""
)
def polar_numbers(spark, d):
    rows = sections(spark, d).select("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("k"), "data")
    rows = rows.select("z", "k", F.get("data", (2 * F.col("k")).cast("int")).alias("re"), F.get("data", (2 * F.col("k") + 1).cast("int")).alias("im"))
    rows = rows.select("z", "k", measure.magnitude(F.col("re"), F.col("im")).alias("size"), measure.phase(F.col("re"), F.col("im")).alias("angle"))
    re, im = measure.from_polar(F.col("size"), F.col("angle"))
    return rows.select("z", "k", *_rounded(size=F.col("size"), angle=F.col("angle"), re=re, im=im))


# operations inside a plane


def _plane(name: str, sql: str, made) -> None:
    def run(spark, d):
        return _long(made(sections(spark, d)))

    run.__name__ = name
    query(pixel_sql=sql)(run)


def _six_digits(planes):
    return planes.withColumn("data", F.transform("data", lambda v: F.round(v, 6) + 0.0))


_of = "OVER (PARTITION BY z, w)"
_plane("invert_plane", f" SELECT z, w, y, x, round(max(v) {_of} - v, 6) AS v FROM pixels", plane.inverted)
_plane("log_plane", " SELECT z, w, y, x, round(greatest(ln(v + 1.1), 0), 6) AS v FROM pixels", lambda s: plane.logarithm(s.withColumn("data", F.transform("data", lambda v: v + 1.1))))
_plane("normalise_range", f" SELECT z, w, y, x, round((v - min(v) {_of}) / (max(v) {_of} - min(v) {_of}), 6) AS v FROM pixels", plane.normalised)
_plane("normalise_deviation", f" SELECT z, w, y, x, round((v - avg(v) {_of}) / stddev_pop(v) {_of}, 6) AS v FROM pixels", lambda s: plane.normalised(s, "deviation"))
_plane("stretch_plane", f" SELECT z, w, y, x, round((v - min(v) {_of}) * (255 / max(v) {_of}), 6) AS v FROM pixels", lambda s: plane.stretched(s, 255))
_plane("threshold_plane", " SELECT z, w, y, x, round(CASE WHEN v > 0.05 THEN v - 0.05 ELSE 0 END, 6) AS v FROM pixels", lambda s: plane.thresholded(s, 0.05, True))
_plane("clip_plane", " SELECT z, w, y, x, round(least(greatest(v, -0.1), 0.1), 6) AS v FROM pixels", lambda s: plane.clipped(s, -0.1, 0.1))
_plane("turn_left", " SELECT z, w, 7 - x AS y, y AS x, v FROM pixels", lambda s: plane.turned(s, 1))
_plane("turn_right", " SELECT z, w, x AS y, 7 - y AS x, v FROM pixels", lambda s: plane.turned(s, -1))
_plane("turn_over", " SELECT z, w, 7 - y AS y, 7 - x AS x, v FROM pixels", lambda s: plane.turned(s, 2))
_plane("mirror_y", " SELECT z, w, 7 - y AS y, x, v FROM pixels", lambda s: plane.mirrored(s, "y"))
_plane("cut_border", " SELECT z, w, y - 2 AS y, x - 2 AS x, v FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5", lambda s: plane.without_border(s, 2))
_plane(
    "pad_plane",
    " SELECT vec_id AS z, label AS w, CAST(p // 11 AS BIGINT) AS y, CAST(p % 11 AS BIGINT) AS x, CASE WHEN p % 11 BETWEEN 1 AND 8 THEN CAST(embedding[(p // 11 + 1) * 8 + p % 11] AS DOUBLE) ELSE -1 END AS v FROM embeddings, (SELECT unnest(range(66)) AS p)",
    lambda s: plane.fitted_to(s, 6, 11, -1),
)
_plane("mask_edge", " SELECT z, w, y, x, CASE WHEN y >= 6 OR x < 2 THEN 0.5 ELSE v END AS v FROM pixels", lambda s: plane.edge_masked(s, 0.5))
_plane("mask_edge_median", " SELECT z, w, y, x, round(CASE WHEN y >= 6 OR x < 2 THEN median(v) FILTER (y < 6 AND x >= 2) OVER (PARTITION BY z, w) ELSE v END, 6) + 0.0 AS v FROM pixels", lambda s: _six_digits(plane.edge_masked(s)))
_plane("mask_region", " SELECT z, w, y, x, CASE WHEN y BETWEEN 1 AND 5 AND x BETWEEN 3 AND 7 THEN 0 ELSE v END AS v FROM pixels", lambda s: plane.region_masked(s, 3, 5, 2))
_plane(
    "squared_gradient",
    """ SELECT z, w, y, x, round(pow((coalesce(lead(v) OVER b, v) - coalesce(lag(v) OVER b, v)) / (CASE WHEN y IN (0, 7) THEN 1 ELSE 2 END), 2)
      + pow((coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / (CASE WHEN x IN (0, 7) THEN 1 ELSE 2 END), 2), 6) AS v
    FROM pixels WINDOW r AS (PARTITION BY z, w, y ORDER BY x), b AS (PARTITION BY z, w, x ORDER BY y)""",
    plane.squared_gradient,
)
_plane("apodise", f" SELECT z, w, y, x, round(v * least(y, x, 7 - y, 7 - x, 3) / 3 + median(v) {_of} * (1 - least(y, x, 7 - y, 7 - x, 3) / 3), 6) AS v FROM pixels", lambda s: plane.apodised(s, 3))


@query(pixel_sql="SELECT w, count(*) FILTER (v >= 0.25) AS saturated FROM pixels GROUP BY w")
def saturated_pixels(spark, d):
    return plane.saturated(sections(spark, d), 0.25)


@query(pixel_sql=" SELECT z, w, y, x, round(lag(v) OVER r - v, 6) AS v FROM pixels WINDOW r AS (PARTITION BY z, w, y ORDER BY x) QUALIFY x > 0")
def derivative_reverse(spark, d):
    rows = plane.each(sections(spark, d), lambda y, x: F.round(plane.at(y, x) - plane.at(y, x + 1), 6), F.col("ny"), F.col("nx") - 1)
    return _long(rows).withColumn("x", F.col("x") + 1)


# made stacks

_GRID = "SELECT p // 12 AS y, p % 12 AS x, sqrt(pow(p // 12 - 7.5, 2) + pow(p % 12 - 5.5, 2)) AS r, greatest(abs(p // 12 - 7.5), abs(p % 12 - 5.5)) AS q FROM (SELECT unnest(range(192)) AS p)"
_profiles_sql = _sql(
    disc="CASE WHEN r <= 4 THEN 1.0::DOUBLE ELSE 0 END",
    ring="CASE WHEN r > 2 AND r <= 5 THEN 1.0::DOUBLE ELSE 0 END",
    square="CASE WHEN q <= 3 THEN 1.0::DOUBLE ELSE 0 END",
    cone="greatest(1 - r / 6, 0) / (pi() * 36 / 3)",
    gauss="exp(-r * r / 18) / pow(sqrt(2 * pi()) * 3, 2)",
    gauss_peak="7 * exp(-r * r / 18)",
    log_zero="10 / (2 * pow(4 / sqrt(2), 2)) * (2 * pow(4 / sqrt(2), 2) - r * r) * exp(-r * r / 16)",
    hat="2 / sqrt(3) * pow(pi(), -0.25) * (2 - pow(r / 5, 2)) * exp(-pow(r / 5, 2) / 2)",
    lorentz="gamma(1.5) / (pow(pi(), 1.5) * 4) * pow(1 + r * r / 4, -1.5)",
    sinc="CASE WHEN r = 0 THEN 1 ELSE sin(r * pi() / 12) / (r * pi() / 12) END",
    cosine="CASE WHEN r > 6 THEN 0 ELSE pow(cos(r * pi() / 12), 2) END",
    angle="atan2(y - 7.5, x - 5.5)",
    ramp="y * (10.0 / 15) + 2",
    test_x="CASE WHEN y = 8 OR x = 6 THEN 1.0::DOUBLE ELSE 0 END",
)


@query(f"SELECT y, x, {_profiles_sql} FROM ({_GRID})")
def radial_planes(spark, d):
    r, q = generated.radial(16, 12), generated.square_radial(16, 12)
    return generated.made(
        spark, 16, 12,
        disc=curves.disc(r, 4), ring=curves.ring(r, 2, 5), square=curves.disc(q, 3), cone=curves.cone(r / 6, curves.cone_scale(6, 2)),
        gauss=curves.gaussian(r, 2, 3.0), gauss_peak=curves.gaussian(r, 2, 3.0, peak=7.0), log_zero=curves.laplacian_of_gaussian(r, 2, zero=4.0, peak=10.0),
        hat=curves.mexican_hat(r / 5, 2), lorentz=curves.lorentzian(r, 2, 4.0), sinc=curves.sinc(r, 6), cosine=curves.cosine_squared(r, 6, True),
        angle=generated.direction(16, 12), ramp=generated.ramp(16, "y", 2, 12), test_x=generated.cross(16, 12),
    )


@query("""SELECT DISTINCT CAST(floor(j * (sqrt(3) / 2 * 5) + 0.5) AS BIGINT) AS y, CAST(floor(i * 5.0 + CASE WHEN j % 2 = 1 THEN 2.5 ELSE 0 END + 0.5) AS BIGINT) AS x, 1.0::DOUBLE AS v
    FROM (SELECT unnest(range(9)) AS j), (SELECT unnest(range(6)) AS i) WHERE floor(j * (sqrt(3) / 2 * 5) + 0.5) < 40 AND floor(i * 5.0 + CASE WHEN j % 2 = 1 THEN 2.5 ELSE 0 END + 0.5) < 30""")
def hexagonal_pattern(spark, d):
    return generated.hexagonal(spark, 40, 30, 5)


@query("SELECT CAST(floor(2 + k * (5.0 / 9) + 0.5) AS BIGINT) AS y, CAST(floor(1 + k + 0.5) AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS v FROM (SELECT unnest(range(10)) AS k) GROUP BY 1, 2")
def drawn_line(spark, d):
    return generated.drawn_line(spark, (2, 1), (7, 10))


_T = "CAST(l_quantity AS DOUBLE)"


@query(
    "SELECT l_orderkey, l_linenumber, "
    + _sql(
        gauss_fit="3 + 20 * exp(-pow(t - 12, 2) / 32)", decay="2 + 30 * exp(-t * ln(2) / 7) + 5 * exp(-t * ln(2) / 40)", poly="1 + t * (0.5 + t * (-0.25))", line="3 * t - 4", paired="2 * t + 1 + (0.5 * t - 1) * t * t",
        exp_decay="50 * exp(-0.1 * t)", density="0.2 * exp(-0.2 * t)", cosine="4 * cos(2 * (radians(t) - radians(30))) + 1", skew="1 + 9 * exp(-pow(19.5 - t, 2) / (2 * 9 * pow(t, 0.5)))", skew2="1 + 9 * exp(-pow(20 - t, 2) / (9 * (0.1 * t + 2)))", sigmoid="1 / (1 + exp(-(t - 25) / 6))",
    )
    + f" FROM (SELECT l_orderkey, l_linenumber, {_T} AS t FROM lineitem)"
)
def model_curves(spark, d):
    t = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        *_rounded(
            gauss_fit=curves.peak_1d(t, 3, 20, 12, 4), decay=curves.decay(t, 2, [(30, 7), (5, 40)]), poly=curves.polynomial(t, [1, 0.5, -0.25]), line=curves.line(t, 3, -4), paired=curves.paired_polynomial(t, [2, 1, 0.5, -1]),
            exp_decay=curves.exponential_decay(t, 0.1, 50), density=curves.exponential_density(t, 0.2), cosine=curves.cosine(t, 4, 2, 30, 1), skew=curves.skewed_peak(t, 1, 9, 20, 3, 0.5), skew2=curves.peak_1d(t, 1, 9, 20, 3, (0.1, 2)), sigmoid=curves.sigmoid(t, 25, 6),
        ),
    )


# coordinates

_POINTS = "SELECT vec_id, e[1] * 10 AS py, e[2] * 10 AS px, e[3] * 10 AS qy, e[4] * 10 AS qx, e[5] AS cy, e[6] AS cx, e[7] * 100 AS a, 1 + e[8] AS m, e[9] * 10 AS ty, e[10] * 10 AS tx FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _points(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = lambda i: F.get("e", F.lit(i))
    return e.select("vec_id", *[(n(i) * 10).alias(c) for i, c in enumerate(("py", "px", "qy", "qx"))], n(4).alias("cy"), n(5).alias("cx"), (n(6) * 100).alias("a"), (1 + n(7)).alias("m"), (n(8) * 10).alias("ty"), (n(9) * 10).alias("tx"))


def _pairs():
    """The points p, q, c and t."""
    return [(F.col(f"{c}y"), F.col(f"{c}x")) for c in "pqct"]


@query(
    "SELECT vec_id, "
    + _sql(
        rot_y="(py - cy) * cos(radians(a)) + (px - cx) * sin(radians(a)) + cy", rot_x="-(py - cy) * sin(radians(a)) + (px - cx) * cos(radians(a)) + cx", zoom_y="(py - cy) * m + cy", zoom_x="(px - cx) * m + cx",
        aff_y="cos(radians(a)) * (py - cy) - sin(radians(a)) * (px - cx) + ty", aff_x="sin(radians(a)) * m * (py - cy) + cos(radians(a)) * m * (px - cx) + tx",
        idx_y="(-sin(radians(a)) * (px - cx) + cos(radians(a)) * (py - cy)) / m + ty + cy", idx_x="(cos(radians(a)) * (px - cx) + sin(radians(a)) * (py - cy)) / m + tx + cx",
        flip_y="2 * cy - py - ty", flip_x="px", distance="sqrt(pow(py - qy, 2) + pow(px - qx, 2))", angle="atan2(qy - py, qx - px)",
    )
    + f", sqrt(pow(py - qy, 2) + pow(px - qx, 2)) < 2 AS near FROM ({_POINTS})"
)
def coordinates(spark, d):
    a, m, (p, q, c, t) = F.col("a"), F.col("m"), _pairs()
    made = {"rot": geometry.rotate(p, a, c), "zoom": geometry.zoom(p, m, c), "aff": geometry.affine(p, a, m, t, c), "idx": geometry.affine_index(p, a, (m, m), t, c), "flip": geometry.flip(p, "Y", c, t)}
    return _points(spark, d).select("vec_id", *_rounded(**{f"{n}_{c}": v for n, at in made.items() for c, v in zip("yx", at)}, distance=geometry.distance(p, q), angle=geometry.angle(p, q)), geometry.near(p, q, 2.0).alias("near"))


_U = "coalesce(((cx - px) * (qx - px) + (cy - py) * (qy - py)) / nullif(pow(qx - px, 2) + pow(qy - py, 2), 0), 0)"


@query(
    "SELECT vec_id, "
    + _sql(side="(cy - py) * (qx - px) - (cx - px) * (qy - py)", line=f"sqrt(pow(cx - px - {_U} * (qx - px), 2) + pow(cy - py - {_U} * (qy - py), 2))", segment=f"sqrt(pow(cx - px - least(greatest({_U}, 0), 1) * (qx - px), 2) + pow(cy - py - least(greatest({_U}, 0), 1) * (qy - py), 2))",
           box="least(" + ", ".join(f"sqrt(pow(cy - {y}, 2) + pow(cx - {x}, 2))" for y, x in [(f"least(greatest(cy, least(py, qy)), greatest(py, qy))", c) for c in ("px", "qx")] + [(c, "least(greatest(cx, least(px, qx)), greatest(px, qx))") for c in ("py", "qy")]) + ")")
    + f", cy BETWEEN least(py, qy) AND greatest(py, qy) AND cx BETWEEN least(px, qx) AND greatest(px, qx) AS inside, abs(py - qy) < 1 AND abs(px - qx) < 1 AS equal, abs(py - cy) < 3 AND abs(px - cx) < 3 AND abs(qy - ty) < 3 AND abs(qx - tx) < 3 AS opposite FROM ({_POINTS})"
)
def segments(spark, d):
    p, q, c, t = _pairs()
    s = (p, q)
    sides = _points(spark, d).withColumn("sides", geometry.box_segments(s))
    return sides.select(
        "vec_id", *_rounded(side=geometry.side(c, s), line=geometry.to_line(c, s), segment=geometry.to_line(c, s, True), box=geometry.to_segments(c, F.col("sides"))),
        geometry.inside(c, s).alias("inside"), geometry.equal(p, q, 1.0).alias("equal"), geometry.opposite(s, (t, c), 3.0).alias("opposite"),
    )


@query(f"SELECT label, {_sql(y0='min(least(py, qy))', x0='min(least(px, qx))', y1='max(greatest(py, qy))', x1='max(greatest(px, qx))')} FROM ({_POINTS}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label")
def bounding_boxes(spark, d):
    (y0, x0), (y1, x1) = geometry.corners((_pairs()[0], _pairs()[1]))
    rows = table(spark, d, "embeddings").select("vec_id", "label").join(_points(spark, d), "vec_id")
    return rows.groupBy("label").agg(*_rounded(y0=F.min(y0), x0=F.min(x0), y1=F.max(y1), x1=F.max(x1)))


@query(
    """SELECT p_partkey, CAST(trunc(n / 2.0 + 0.5000001 - 3.5) AS BIGINT) AS c0, CAST(trunc(n / 2.0 + 0.5000001 + 3.5) AS BIGINT) AS c1, CAST(trunc(n / 2.0 + 0.5000001 - n * 0.25 / 2) AS BIGINT) AS s0, CAST(trunc(n / 2.0 + 0.5000001 + n * 0.25 / 2) AS BIGINT) AS s1,
    CAST(greatest(trunc(p + 0.5000001 - 2.5), 0) AS BIGINT) AS n0, CAST(least(trunc(p + 0.5000001 + 2.5), n) AS BIGINT) AS n1, n - n % 2 AS less, n + n % 2 AS more,
    CASE WHEN (n - p) % 2 = 1 AND p <> 3 THEN p - 1 ELSE p END AS e0, CASE WHEN (n - p) % 2 = 1 AND p = 3 THEN CASE WHEN n <> 50 THEN n + 1 ELSE n - 1 END ELSE n END AS e1
    FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, CAST(p_size // 2 AS BIGINT) AS p FROM part)"""
)
def slices(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"), F.expr("cast(p_size div 2 as bigint)").alias("p"))
    n, p = F.col("n"), F.col("p")
    pairs = {"c": geometry.centre_slice(n, 7.0), "s": geometry.centre_slice(n, 0.25), "n": geometry.nearby(n, p, 5.0), "e": geometry.even_span(p, n, 3, 50)}
    return rows.select("p_partkey", *[v.alias(f"{c}{i}") for c, pair in pairs.items() for i, v in enumerate(pair)], geometry.even(n).alias("less"), geometry.even(n, False).alias("more"))


# optics

_OPTICS_SQL = _sql(
    rayleigh="0.61 * wave / na", abbe="wave / (2 * na)", limit_um="0.61 * wave / (n * na)", half_angle="degrees(asin(na / n))", refracted="degrees(asin(n * sin(0.5) / 1.6))", diameter="2 * depth * tan(asin(na / n))",
    frequency="0.088 * 512 / 1.1 * (2 * depth * tan(asin(na / n)) / (0.088 * 512))", divergence="degrees(4 * 1.05 * wave / 1e6 / (pi() * 1.5))", beam="1000 * tan(4 * 1.05 * wave / 1e6 / (pi() * 1.5)) * 2 + 1.5",
    rescan="sqrt(pow(wave / 2.5, 2) + pow(1.5 * 250 / 2.5, 2))", factor="1 + wave * wave / 62500", width="wave * 250 / sqrt(wave * wave + 62500)", reassigned="62500 / (62500 + wave * wave) * sqrt(62500 + wave * wave)",
)
_COLOUR_SQL = "CASE WHEN w2 <= 350 THEN CASE CAST(floor(w2) AS BIGINT) % 7 WHEN 0 THEN '101' WHEN 1 THEN '011' WHEN 2 THEN '110' WHEN 3 THEN '001' WHEN 4 THEN '010' WHEN 5 THEN '100' ELSE '111' END WHEN w2 < 420 THEN '101' WHEN w2 < 460 THEN '001' WHEN w2 < 500 THEN '011' WHEN w2 < 540 THEN '010' WHEN w2 < 580 THEN '110' WHEN w2 < 640 THEN '100' WHEN w2 < 700 THEN '101' WHEN w2 < 1100 THEN '111' END"


@query(
    f"""SELECT p_partkey, {_OPTICS_SQL}, {_COLOUR_SQL} AS colour, CASE {_COLOUR_SQL} WHEN '101' THEN 'purple' WHEN '001' THEN 'blue' WHEN '011' THEN 'cyan' WHEN '010' THEN 'green' WHEN '110' THEN 'yellow' WHEN '100' THEN 'red' WHEN '111' THEN 'white' END AS colour_name
    FROM (SELECT p_partkey, 400.0 + p_size * 5 AS wave, 0.5 + p_size / 100.0 AS na, 1.33 AS n, CAST(p_size AS DOUBLE) AS depth, CAST(p_retailprice AS DOUBLE) - 700 AS w2 FROM part)"""
)
def optics_table(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.lit(400.0) + F.col("p_size") * 5).alias("wave"), (F.lit(0.5) + F.col("p_size") / 100).alias("na"), F.lit(1.33).alias("n"), F.col("p_size").cast("double").alias("depth"), (F.col("p_retailprice") - 700).alias("w2"))
    wave, na, n, depth, fixed = F.col("wave"), F.col("na"), F.col("n"), F.col("depth"), F.lit(250.0)
    divergence, beam = optics.beam(F.lit(1.05), wave, F.lit(1.5), F.lit(1000.0))
    return rows.select(
        "p_partkey",
        *_rounded(
            rayleigh=optics.rayleigh(na, wave), abbe=optics.abbe(na, wave), limit_um=optics.limit(na, wave, n), half_angle=optics.half_angle(na, n), refracted=optics.refracted(n, F.lit(0.5), F.lit(1.6)), diameter=optics.imaged_diameter(depth, n, na),
            frequency=optics.back_focal_frequency(F.lit(1.1), depth, n, na, 0.088, 512), divergence=divergence, beam=beam, rescan=optics.rescan_resolution(wave, fixed, F.lit(2.5)), factor=optics.rescan_factor(wave, fixed),
            width=optics.rescan_width(wave, fixed), reassigned=optics.reassigned_resolution(wave, fixed),
        ),
        optics.colour(F.col("w2")).alias("colour"), optics.colour_name(optics.colour(F.col("w2"))).alias("colour_name"),
    )


# numbers


@query(
    """WITH primes AS (SELECT p FROM (SELECT unnest(range(2, 60)) AS p) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 60)) AS q) b WHERE q < p AND p % q = 0)),
    factors AS (SELECT n, list(p ORDER BY p) AS factors FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS n FROM part), primes, (SELECT unnest(range(1, 7)) AS k) WHERE pow(p, k) <= n AND n % CAST(pow(p, k) AS BIGINT) = 0 GROUP BY n)
    SELECT p_partkey, lpad(bin(p_size), 8, '0') AS bits, n IN (SELECT p FROM primes) AS prime, coalesce(factors, []) AS factors, CASE WHEN n <= 20 THEN CAST(factorial(CAST(n AS INT)) AS BIGINT) END AS factorial,
      round(CASE WHEN n <= 20 THEN gamma(n / 2.0) END, 4) AS half_gamma, CAST(sign(p_retailprice - 1400) AS BIGINT) AS sign
    FROM (SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS BIGINT) AS n FROM part) LEFT JOIN factors USING (n)"""
)
def number_facts(spark, d):
    n = F.col("p_size").cast("long")
    return table(spark, d, "part").select(
        "p_partkey", numbers.binary_text(n).alias("bits"), numbers.is_prime(n).alias("prime"), numbers.prime_factors(n).alias("factors"), numbers.factorial(n).alias("factorial"),
        F.round(F.when(n <= 20, numbers.half_gamma(n / 2)), 4).alias("half_gamma"), F.signum(F.col("p_retailprice") - 1400).cast("long").alias("sign"),
    )


@query("WITH RECURSIVE f(nth, value, after) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT nth + 1, after, value + after FROM f WHERE after <= 10000) SELECT nth, value, CAST(value AS DOUBLE) AS closed FROM f")
def fibonacci(spark, d):
    return numbers.fibonacci(spark, 10_000).withColumn("closed", F.round(numbers.fibonacci_number(F.col("nth")), 0))


@query("SELECT p AS prime FROM (SELECT unnest(range(2, 501)) AS p) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 23)) AS q) b WHERE q < p AND p % q = 0)")
def primes(spark, d):
    return numbers.primes(spark, 500)


@query("SELECT i // 12 AS i0, (i // 4) % 3 AS i1, i % 4 AS i2 FROM (SELECT unnest(range(24)) AS i)")
def array_indices(spark, d):
    return numbers.indices(spark, 2, 3, 4)
