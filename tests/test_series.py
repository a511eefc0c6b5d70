"""Focus, drift, Zernike numbering and header lines against known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planecraft.functions import names
from planecraft.operators import beads, focus, generated, region
from planecraft.plans import catalogue
from planecraft.sources import param_files


def test_known_drift_is_found_in_both_channels(spark, sf):
    rows = catalogue.QUERIES["time_drift"](spark, sf).collect()
    assert {(r.t, r.w) for r in rows} == {(t, w) for t in range(4) for w in range(2)}
    for r in rows:
        assert (r.ty, r.tx, r.r, r.my, r.mx) == pytest.approx((-1.5 * r.t, 0.75 * r.t, 0, 1, 1), abs=0.3), r


def test_sharp_sections_are_in_focus(spark):
    rng = np.random.default_rng(3)
    sharp = rng.normal(size=(7, 24, 30))
    rows = [(z, 0, 24, 30, (sharp[z] * (3 if z in (0, 3, 4) else 1)).ravel().tolist()) for z in range(7)]
    rows += [(z, 1, 24, 30, [1.0] * 720) for z in range(3)] + [(z, 2, 24, 30, [1.0] * 720) for z in range(5)]
    found = focus.in_focus(spark.createDataFrame(rows, "z long, w long, ny int, nx int, data array<double>")).collect()
    assert sorted((r.w, r.z) for r in found) == [(0, 3), (0, 4), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_large_planes_are_read_in_steps():
    image = np.random.default_rng(1).normal(size=(1024, 40))
    assert focus.detail(image) == pytest.approx(focus.detail(image[::2]))


def test_zernike_numbers():
    assert [generated.zernike_term(n)[:2] for n in range(10)] == [(0, 0), (1, 1), (1, 1), (1, 0), (2, 2), (2, 2), (2, 1), (2, 1), (2, 0), (3, 3)]
    assert [n for n in range(16) if generated.zernike_term(n)[2]] == [2, 5, 7, 10, 12, 14]


def test_stacks_of_other_lengths_keep_their_middle(spark):
    schema = "t int, w int, z int, data array<double>"
    long = spark.createDataFrame([(0, 0, z, [float(z), 0.0]) for z in range(4, 9)], schema)
    short = spark.createDataFrame([(0, 0, z, [0.0, float(z)]) for z in range(2)], schema)
    assert sorted((r.z, r.data) for r in region.maximum_of([long, short]).collect()) == [(0, [5.0, 0.0]), (1, [6.0, 1.0])]


def test_header_lines_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nt,2\nnw,3\npxlsiz_z_y_x,0.2,0.08,0.09\nrefwave,1\nt,wavelength,tz,ty,tx,r,mz,my,mx\n0,488.0,0,0,0,0,1,1,1\n")
    (tmp_path / "b.csv").write_text("nt,x\n")
    got = {r.file.rsplit("/", 1)[1]: tuple(r)[1:] for r in param_files.headers(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (2, 3, 0.2, 0.08, 0.09, 1), "b.csv": (None,) * 6}


def test_beads_of_one_cell_and_at_the_border_of_the_distance(spark):
    rows = [(0, 1, 0.0, 0.0), (0, 2, 0.5, 0.5), (0, 3, 0.5, 4.4), (0, 4, 30.0, 0.0), (0, 5, 30.0, 4.0), (1, 6, 0.0, 0.0), (0, 7, -50.0, -0.1), (0, 8, -50.0, 3.8), (0, 9, -90.0, 0.0), (0, 10, -90.0, 0.0)]
    found = beads.alone(spark.createDataFrame(rows, "image int, bead int, y double, x double"), 4.0).collect()
    assert sorted(r.bead for r in found) == [4, 5, 6]


def test_a_bead_goes_with_its_worst_channel(spark):
    rows = [(0, b, w, 10.0 + d, 5.0) for b, ds in ((1, (0, 1, 2)), (2, (0, 1, 9)), (3, (0, 0, 1))) for w, d in enumerate(ds)] + [(0, 4, 1, 1.0, 1.0)]
    off = beads.deviations(spark.createDataFrame(rows, "image int, bead int, w int, y double, x double"), 0, (2.0, 3.0), 10.0)
    assert sorted(map(tuple, off.collect())) == [(0, 1, 1, 20.0, 15.0, 2.0, 0.0), (0, 1, 2, 20.0, 15.0, 4.0, 0.0)]


def test_odd_names(spark):
    given = ["a.b/c", ".hidden", "x_099.ome.tif", "", None, "run9.tif"]
    made = spark.createDataFrame([(n,) for n in given], "n string").select("n", names.with_extension(F.col("n"), "npy").alias("e"), names.next_numbered(F.col("n")).alias("f")).collect()
    assert {r.n: (r.e, r.f) for r in made} == {"a.b/c": ("a.b/c.npy", "a.b/c0"), ".hidden": (".hidden.npy", ".hidden0"), "x_099.ome.tif": ("x_099.ome.npy", "x_099.ome0.tif"), "": (".npy", "0"), None: (None, None), "run9.tif": ("run9.npy", "run10.tif")}
    both = spark.createDataFrame([(["abc1", "abd", "ab"],), (["q"],), ([],)], "n array<string>").select(names.common_start(F.col("n")).alias("s")).collect()
    assert [r.s for r in both] == ["ab", "q", None]
