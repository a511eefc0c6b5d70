"""Alignment against known warps, fits against known curves."""

import numpy as np
import pytest

from planecraft.operators import fitting, registration
from planecraft.operators.kernels import affine

RNG = np.random.default_rng(5)


def scene(ny=256, nx=256):
    """Blobs of several widths."""
    y, x = np.mgrid[:ny, :nx].astype(float)
    out = np.zeros((ny, nx))
    for cy, cx, s, h in zip(RNG.uniform(0, ny, 150), RNG.uniform(0, nx, 150), RNG.uniform(1.5, 5, 150), RNG.uniform(20, 100, 150)):
        out += h * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s))
    return out


@pytest.mark.parametrize("truth", [(3, 2, -0.5, 1.001001, 1.002004), (-4.3, 6.2, 0.8, 0.996, 1.003), (0, 0, 0, 1, 1)])
def test_warped_pair_is_recovered(truth):
    a = scene()
    p, quality, good = registration.align(a, affine(a, *truth))
    left = registration.error_in_pixels(np.array([p[0] - truth[0], p[1] - truth[1], p[2] - truth[2], p[3] / truth[3], p[4] / truth[4]]), a.shape)
    assert good and quality > 0 and (left < 0.1).all(), (p, left)


def test_large_turn_by_log_polar_and_simplex():
    a = scene(128, 128)
    b = affine(a, 0, 0, 9.0, 1.05, 1.05)
    p = registration.log_polar(a, b)
    assert p[2] == pytest.approx(9, abs=1.5) and p[3] == pytest.approx(1.05, abs=0.03)
    q = registration.by_simplex(a, b, p)
    assert q == pytest.approx([0, 0, 9, 1.05, 1.05], abs=0.15)


def test_shift_by_values_and_phases():
    a = scene(120, 110)
    for phase in (True, False):
        s, _ = registration.shift_between(a[10:106, 10:90], a[7:103, 15:95], phase)
        assert s == pytest.approx([3, -5], abs=0.5)


def test_aligned_frames_and_application(spark):
    a = scene(96, 96)
    truth = {0: (0, 0, 0, 1, 1), 1: (2, -1, 0.5, 1.002, 0.999), 2: (-3.5, 1.5, -0.7, 1, 1.004)}
    rows = [(z, w, 96, 96, (affine(a, *p) if w else a).ravel().tolist()) for z in (0, 1) for w, p in truth.items()]
    planes = spark.createDataFrame(rows, "z long, w long, ny int, nx int, data array<double>")
    ref = planes.where("w = 0").selectExpr("z", "data AS ref")
    found = {(r.z, r.w): r for r in registration.aligned(planes, ref).collect()}
    assert len(found) == 6
    back = registration.applied(planes, registration.aligned(planes, ref).where("z = 0")).collect()
    for r in back:
        made, inner = np.array(r.data).reshape(96, 96), (slice(12, 84),) * 2
        assert np.corrcoef(made[inner].ravel(), a[inner].ravel())[0, 1] > 0.99


def test_moved_in_z(spark):
    rows = [(z, 0, 1, 2, [float(z), 10.0 * z]) for z in range(5)]
    planes = spark.createDataFrame(rows, "z long, w long, ny int, nx int, data array<double>")
    got = {r.z: r.data for r in registration.moved_in_z(planes, 1.0).collect()}
    assert got == {z: [z - 1.0, 10.0 * (z - 1)] for z in range(1, 5)}
    half = {r.z: r.data for r in registration.moved_in_z(planes, 0.5).collect()}
    assert half[2] == pytest.approx([1.5, 15.0])


def test_fits():
    image = np.full((40, 50), 2.0)
    y, x = np.mgrid[:40, :50]
    for h, cy, cx, s in ((30, 12.3, 20.7, 2.0), (20, 28.6, 35.2, 1.5)):
        image += h * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s))
    found = fitting.all_peaks(image, 5, 8)
    assert [round(h) for h, *_ in found] == [30, 20] and all(g for *_, g in found)
    assert found[0][1] == pytest.approx([12.3, 20.7], abs=0.01) and found[1][2] == pytest.approx([1.5, 1.5], abs=0.02)
    t = np.arange(40.0)
    p, good = fitting.fit_decay(t, 3 + 20 * np.exp2(-t / 6))
    assert good and p == pytest.approx([3, 20, 6], abs=1e-3)
    assert fitting.fit_rate(t, 50 * np.exp(-0.2 * t))[0] == pytest.approx(0.2, abs=1e-6)
    assert fitting.fit_polynomial(t, 1 - 2 * t + 0.5 * t * t, 2) == pytest.approx([1, -2, 0.5])
    assert fitting.simplex(lambda q: (q[0] - 3) ** 2 + (q[1] + 1) ** 2, [0, 0], [1, 1]) == pytest.approx([3, -1], abs=1e-2)


def test_peak_lists(spark):
    y, x = np.mgrid[:30, :30]
    image = 50 * np.exp(-((y - 10.4) ** 2 + (x - 17.8) ** 2) / 8)
    planes = spark.createDataFrame([(z, 1, 30, 30, (image + z).ravel().tolist()) for z in range(3)], "z long, w int, ny int, nx int, data array<double>")
    rows = fitting.peaks(planes, 3, 20).collect()
    assert len(rows) == 3 and all((r.y, r.x, r.sigma_y) == pytest.approx((10.4, 17.8, 2), abs=0.02) and r.fitted for r in rows)
