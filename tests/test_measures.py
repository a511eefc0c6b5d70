"""Quantiles, matched wavelengths, shifts along z and factors on hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planecraft.functions import numbers
from planecraft.operators import params, reduce, registration


def test_wavelengths_are_matched_in_every_frame(spark):
    rows = [(t, w, wave, *[100.0 * t + w] * 7) for t in range(3) for w, wave in ((0, 488.0), (1, 560.9))]
    own = spark.createDataFrame(rows, ["t", "w", "wave", *params.NAMES])
    targets = spark.createDataFrame([(0, 561.0), (1, 488.4), (2, 700.0)], "target int, wave double")
    got = sorted((r.t, r.target, r.tz, r.mx) for r in params.matched(targets, own, 488.0).collect())
    assert got == [(t, i, 100.0 * t + w, 100.0 * t + w) for t in range(3) for i, w in enumerate((1, 0, 0))]


def test_quantiles_are_counted_in_bins(spark):
    rng = np.random.default_rng(6)
    groups = {0: rng.normal(size=20_000).tolist(), 1: [1.0] * 300 + [2.0] * 301, 2: [5.0], 3: [1.0, 4.0]}
    groups[None] = [7.0, 8.0]
    pixels = spark.createDataFrame([(w, v) for w, vs in groups.items() for v in vs] + [(1, None), (4, None)], "w long, v double").repartition(5)
    tops = reduce.percentile(pixels, 0.99, "w")
    mads = reduce.median_mad(pixels, "w")
    assert {r.w: r.v_top for r in tops.collect()} == {w: sorted(vs)[int(np.ceil(0.99 * len(vs))) - 1] for w, vs in groups.items()} | {4: None}
    del groups[None]  # as in SQL, where the join leaves it out
    want = {w: (np.median(vs), np.median(np.abs(vs - np.median(vs)))) for w, vs in groups.items()}
    got = {r.w: (r.v_median, r.v_mad) for r in mads.collect()}
    assert got.pop(4) == (None, None)
    assert set(got) == set(want) and all(np.allclose(got[w], want[w], atol=1e-6) for w in want)
    for plan in (x._jdf.queryExecution().optimizedPlan().toString() for x in (tops, mads)):
        assert "percentile(" not in plan and "median(" not in plan and "percentiledisc" not in plan.lower()  # these hold a group in one buffer


@pytest.mark.parametrize(("accuracy", "most"), [(20_000, 50), (40, 100), (4, 1_000_000)])
def test_quantiles_are_narrowed_until_few_values_are_left(spark, accuracy, most):
    rng = np.random.default_rng(8)
    vs = np.round(rng.normal(size=30_000), 3).tolist()
    pixels = spark.createDataFrame([(0, v) for v in vs] + [(1, 3.0)], "w long, v double").repartition(6)
    ranks = {"low": (0.1, F.floor(F.col("n") * 0.1)), "mid": (0.5, F.floor(F.col("n") / 2)), "top": (1.0, F.col("n") - 1), "first": (0.0, F.lit(0))}
    got = {r.w: r for r in reduce.ranked(pixels, ranks, "w", accuracy=accuracy, most=most).collect()}
    vs.sort()
    assert (got[0].low, got[0].mid, got[0].top, got[0].first) == (vs[3000], vs[15000], vs[-1], vs[0]) and got[1].mid == 3.0


@pytest.mark.parametrize(("shift", "zoom"), [(0.25, 1.0), (-1.5, 1.0), (0.0, 0.5), (0.3, 1.7)])
def test_stacks_move_along_z(spark, shift, zoom):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(9, 6))
    planes = spark.createDataFrame([(z, 1, 2, 3, a[z].tolist()) for z in range(9)], "z long, w long, ny int, nx int, data array<double>")
    moved = registration.moved_in_z(planes, shift, zoom)
    got = {r.z: r.data for r in moved.collect()}
    for z in range(9):
        source = (z - 4 - shift) / zoom + 4
        want = sum((max(0.0, 1 - abs(source - k)) * a[k] for k in range(9)), np.zeros(6))
        assert got.get(z, [0.0] * 6) == pytest.approx(want.tolist(), abs=1e-12)
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower()  # planes are shuffled, not pixels


def test_factors(spark):
    made = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 12, 49, 97, 360, 1_000_003, 999_966_000_289, 2**40)], "n long").select("n", numbers.prime_factors(F.col("n")).alias("f"))
    want = {0: [], 1: [], 2: [2], 3: [3], 4: [2, 2], 12: [2, 2, 3], 49: [7, 7], 97: [97], 360: [2, 2, 2, 3, 3, 5], 1_000_003: [1_000_003], 999_966_000_289: [999_983, 999_983], 2**40: [2] * 40}
    assert {r.n: r.f for r in made.collect()} == want
