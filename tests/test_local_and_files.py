"""Local alignment against a known map, and image files there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planecraft.operators import kernels, local
from planecraft.sources import image_files


def test_local_map_is_recovered(spark):
    rng, n = np.random.default_rng(4), 192
    y, x = np.mgrid[:n, :n].astype(float)
    a = np.zeros((n, n))
    for cy, cx in rng.uniform(0, n, (600, 2)):
        a += 50 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 8)
    dy = 1.5 * np.exp(-((y - 70) ** 2 + (x - 90) ** 2) / (2 * 40**2))
    dx = -1.2 * np.exp(-((y - 110) ** 2 + (x - 80) ** 2) / (2 * 40**2))
    b = local.sampled(a, y - dy, x - dx)
    plane = lambda z, w, d: (z, w, n, n, d.ravel().tolist())
    schema = "z long, w long, ny int, nx int, data array<double>"
    own = spark.createDataFrame([plane(z, 1, a) for z in range(2)], schema)
    ref = spark.createDataFrame([plane(z, 0, b) for z in range(2)], schema)
    shifts = local.tile_shifts(local.tiles(own, n, n, 32), local.tiles(ref, n, n, 32), 32)
    assert shifts.where("accepted").count() > 0.8 * shifts.count()
    maps = local.displacement(shifts, 32)
    for r in maps.collect():
        inner = (slice(30, -30),) * 2
        assert np.abs(np.array(r.dy).reshape(n, n) - dy)[inner].mean() < 0.15
        assert np.abs(np.array(r.dx).reshape(n, n) - dx)[inner].mean() < 0.15
    for r in local.remapped(own, maps).collect():
        made, inner = np.array(r.data).reshape(n, n), (slice(30, -30),) * 2
        assert np.abs(made - b)[inner].mean() < 0.5 * np.abs(a - b)[inner].mean()


@pytest.mark.parametrize("order", [1, 3])
def test_maps_come_on_top_of_an_affine_map(spark, order):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(24, 17))
    p = (1.2, -0.7, 3.0, 1.05, 0.97)
    planes = spark.createDataFrame([(z, w, 24, 17, a.ravel().tolist()) for z in range(2) for w in range(2)], "z long, w long, ny int, nx int, data array<double>")
    shift = lambda w, v: [v if w else 0.0] * a.size
    maps = spark.createDataFrame([(z, w, shift(w, 0.5), shift(w, -1.25)) for z in range(2) for w in range(2)], "z long, w long, dy array<double>, dx array<double>")
    params = spark.createDataFrame([(0, *p)], "w long, ty double, tx double, r double, my double, mx double")
    made = {(r.z, r.w): np.reshape(r.data, a.shape) for r in local.remapped(planes, maps, order, params).collect()}
    assert np.allclose(made[0, 0], kernels.affine(a, *p, order=order)) and np.allclose(made[1, 1], kernels.affine(a, 0.5, -1.25, 0, 1, 1, order=order))


def test_cubic_splines_go_through_their_values():
    a = np.random.default_rng(1).normal(size=(9, 1))
    for plane in (a, a.T, np.random.default_rng(2).normal(size=(7, 30))):
        y, x = np.mgrid[: plane.shape[0], : plane.shape[1]].astype(float)
        assert np.allclose(kernels.cubic(plane, y, x), plane)
    y, x = np.mgrid[:40, :40].astype(float)
    smooth = lambda v, u: np.sin(v / 5) * np.cos(u / 6)
    inner = (slice(6, -6),) * 2
    assert np.abs(kernels.cubic(smooth(y, x), y + 0.3, x - 0.4) - smooth(y + 0.3, x - 0.4))[inner].max() < 1e-4


def test_tile_starts_and_holes():
    assert local.starts(100, 32, False) == [0, 32, 64] and local.starts(100, 32, True) == [16, 48]
    shift, good = np.zeros((2, 3, 5)), np.zeros((3, 5), bool)
    shift[:, 1, 1], good[1, 1] = (4.0, -2.0), True
    assert (local.filled_grid(shift, good) == np.array([4.0, -2.0])[:, None, None]).all()
    assert not local.filled_grid(shift, np.zeros((3, 5), bool)).any()
    spiked = np.ones((2, 5, 5))
    spiked[:, 2, 2] = 99
    good = np.ones((5, 5), bool)
    good[2, 2] = False
    assert (local.median_grid(spiked, good) == 1).all()


@pytest.mark.parametrize("kind, dtype", [("mrc", "int16"), ("mrc", "float32"), ("mrc", "uint16"), ("tif", "uint16"), ("tif", "float32"), ("tif", "uint8"), ("npy", "int32")])
def test_files_there_and_back(spark, tmp_path, kind, dtype):
    rng = np.random.default_rng(1)
    nt, nw, nz = (2, 2, 3) if kind != "tif" else (1, 1, 4)
    rows = [(f"s.{kind}", t, w, z, 4, 6, dtype, 488.0 + 73 * w, 0.2, 0.08, 0.1, rng.integers(0, 200, 24).astype(float).tolist()) for t in range(nt) for w in range(nw) for z in range(nz)]
    planes = spark.createDataFrame(rows, image_files.PLANES).repartition(3)
    for r in image_files.contents(planes, kind).collect():
        (tmp_path / r.file).write_bytes(r.content)
    back = image_files.read(spark, str(tmp_path))
    key = lambda r: (r.t, r.w, r.z)
    got, want = sorted(back.collect(), key=key), sorted(planes.collect(), key=key)
    assert [(key(r), r.ny, r.nx, r.dtype, r.data) for r in got] == [(key(r), r.ny, r.nx, r.dtype, r.data) for r in want]
    if kind == "mrc":
        assert [(r.wave, r.px) for r in got] == [(r.wave, pytest.approx(r.px)) for r in want]


def test_big_endian_tiff_and_bad_files():
    import struct

    page = np.arange(6, dtype=">u2").reshape(2, 3)
    fields = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (273, 4, 8), (279, 4, 12)]
    raw = b"MM\0*" + struct.pack(">I", 20) + page.tobytes() + struct.pack(">H", len(fields))
    raw += b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields) + b"\0" * 4
    assert (image_files.tiff_pages(raw)[0] == page).all()
    for bad in (b"", b"II*\0", b"nonsense" * 200):
        with pytest.raises((ValueError, struct.error)):
            image_files.tiff_pages(bad)
    with pytest.raises(ValueError):
        image_files.mrc_planes(b"\xff" * 2000)
