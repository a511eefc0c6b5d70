"""Known maps under noise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planecraft.operators import trials

TRUTH = {"ty": 1.5, "tx": -2.0, "r": 0.5, "my": 1.002, "mx": 1.001}


@pytest.fixture(scope="module")
def planes(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:128, :128].astype(float)
    rows = []
    for z in range(3):
        a = sum(400 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 10) for cy, cx in rng.uniform(0, 128, (250, 2)))
        rows.append((z, 0, 128, 128, a.ravel().tolist()))
    return spark.createDataFrame(rows, "z long, w long, ny int, nx int, data array<double>")


def test_noise_is_gaussian_and_the_same_again(spark):
    flat = spark.createDataFrame([(0, 0, 200, 200, [100.0] * 40_000), (1, 0, 200, 200, [100.0] * 40_000)], "z long, w long, ny int, nx int, data array<double>")
    made = {(r.z, r.noise): np.array(r.data) for r in trials.with_noise(flat, [1, 4], 10.0).collect()}
    again = {(r.z, r.noise): np.array(r.data) for r in trials.with_noise(flat.repartition(2), [1, 4], 10.0).collect()}
    assert all((made[k] == again[k]).all() for k in made) and len(made) == 4
    for (_, d), a in made.items():
        rest = a - 100 / d
        assert abs(rest.mean()) < 0.2 and rest.std() == pytest.approx(10, abs=0.2) and np.mean(np.abs(rest) < 10) == pytest.approx(0.6827, abs=0.01)
    assert abs(np.corrcoef(made[0, 1.0], made[1, 1.0])[0, 1]) < 0.03


def test_errors_grow_with_noise(planes):
    made = trials.compared(planes, TRUTH, [1, 60], 10.0, ("quadrants", "shift"))
    rows = made.collect()
    assert len(rows) == 12 and {r.z for r in rows} == {0, 1, 2}
    for r in rows:
        d = {"dty": (r.ty - 1.5) * 80, "dtx": (r.tx + 2) * 80, "dmy": (r.my - 1.002) * 64 * 80}
        assert all(r[c] == pytest.approx(v, abs=1e-6) for c, v in d.items())
        assert r.total == pytest.approx(np.sqrt(sum(r[c] ** 2 for c in ("dty", "dtx", "dr", "dmy", "dmx"))))
    me = {(r.method, r.noise): r.me for r in trials.summary(made).collect()}
    assert me["quadrants", 1.0] < 25  # nanometres, of pixels of 80
    assert me["quadrants", 1.0] < me["shift", 1.0] and me["quadrants", 1.0] < me["quadrants", 60.0]
    assert trials.compared(planes.where(F.lit(False)), TRUTH, [1], 1.0).collect() == []


def test_warps_are_found_by_tiles(planes):
    one = planes.where("z < 2")
    maps = trials.warps(one, [(0.5, 0.5, 1.5), (0.2, 0.2, -0.8)], [(0.25, 0.75, 1.2)], 25.0)
    r = maps.first()
    y, x = np.mgrid[:128, :128]
    hill = lambda a, b, h: h * np.exp(-((y - a * 128) ** 2 + (x - b * 128) ** 2) / 1250)
    assert np.allclose(np.reshape(r.dy, (128, 128)), hill(0.5, 0.5, 1.5) + hill(0.2, 0.2, -0.8)) and np.allclose(np.reshape(r.dx, (128, 128)), hill(0.25, 0.75, 1.2))
    got = {(r.z, r.window): r for r in trials.local_compared(one, maps, [60, 24]).collect()}
    assert set(got) == {(z, w) for z in (0, 1) for w in (60, 24)}
    for z in (0, 1):
        assert got[z, 24].regions > got[z, 60].regions > 0 and got[z, 24].me < 30 and got[z, 24].pearson > 0.97
        assert got[z, 24].me <= got[z, 24].ma and got[z, 24].sd > 0
