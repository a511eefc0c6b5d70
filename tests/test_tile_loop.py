"""Coarse-to-fine tiles against known maps."""

import numpy as np
import pytest

from planecraft.operators import local, tile_loop

SCHEMA = "z long, w long, ny int, nx int, data array<double>"


def scene(n, seed=4, empty=None):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n].astype(float)
    a = np.zeros((n, n))
    for cy, cx in rng.uniform(0, n, (int(n * n / 60), 2)):
        if empty is None or not (empty[0] < cy < empty[1] and empty[0] < cx < empty[1]):
            a += 50 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 8)
    return a, y, x


def test_windows():
    assert tile_loop.windows(256, 300, 32) == [128, 64, 32] and tile_loop.windows(1008, 1012, 60) == [300, 150, 76]
    assert tile_loop.windows(40, 40, 32) == []


def test_a_known_map_is_recovered_and_rounds_shrink(spark):
    n = 192
    a, y, x = scene(n)
    # shifts up to 4.5 pixels: more than one round of a small window reaches
    dy = 4.5 * np.exp(-((y - 90) ** 2 + (x - 95) ** 2) / (2 * 45**2))
    dx = -3.5 * np.exp(-((y - 105) ** 2 + (x - 90) ** 2) / (2 * 45**2))
    b = local.sampled(a, y - dy, x - dx)
    plane = lambda z, w, d: (z, w, n, n, d.ravel().tolist())
    own, ref = (spark.createDataFrame([plane(z, w, d) for z in range(2)] + [(9, w, 3, 3, [0.0] * 9)], SCHEMA) for w, d in ((1, a), (0, b)))
    shifts, trace = tile_loop.refined(own, ref, n, n, tile_loop.Loop(least_window=24))
    rows = shifts.collect()
    assert {r.z for r in rows} == {0, 1} and sum(r.accepted for r in rows) > 0.7 * len(rows)
    errors = []
    for r in rows:
        cy, cx = r.y0 + 11, r.x0 + 11
        if r.accepted and 30 < cy < n - 30 and 30 < cx < n - 30:
            errors.append(np.hypot(r.dy - dy[cy, cx], r.dx - dx[cy, cx]))
    assert np.mean(errors) < 0.2 and np.quantile(errors, 0.95) < 0.6
    for size in {t[0] for t in trace}:
        counts = [t[2] for t in trace if t[0] == size]
        assert all(p >= q for p, q in zip(counts, counts[1:])) and (len(counts) == 1 or counts[-1] < counts[0])
    maps = local.displacement(shifts, 24).collect()
    inner = (slice(30, -30),) * 2
    assert np.abs(np.array(maps[0].dy).reshape(n, n) - dy)[inner].mean() < 0.25


def test_an_empty_part_is_filled(spark):
    n = 128
    a, y, x = scene(n, 7, (40, 90))
    b = local.sampled(a, y - 1.5, x + 1.0)
    own, ref = (spark.createDataFrame([(0, w, n, n, d.ravel().tolist())], SCHEMA) for w, d in ((1, a), (0, b)))
    rows = tile_loop.refined(own, ref, n, n, tile_loop.Loop(least_window=16))[0].collect()
    out = [r for r in rows if not r.accepted]
    assert out and all(abs(r.dy) > 0 for r in out)
    good = [r for r in rows if r.accepted and 20 < r.y0 < 90 and 20 < r.x0 < 90]
    assert np.median([r.dy for r in good]) == pytest.approx(1.5, abs=0.15) and np.median([r.dx for r in good]) == pytest.approx(-1.0, abs=0.15)
    with pytest.raises(ValueError, match="too small"):
        tile_loop.refined(own, ref, 20, 20)
