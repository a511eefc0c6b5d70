"""Text arrays, series of files, splines over frames, windows round points and reports, on small cases."""

import bz2
import gzip

import numpy as np
import pytest

from planecraft.operators import cutouts, frames
from planecraft.sources import array_text, param_files, reports, series


def test_lines_are_numbered_across_splits(spark, tmp_path):
    want = {f"f{k}.txt": [f"{k}:{i}" + "x" * (i % 7) for i in range(n)] for k, n in enumerate((1, 500, 0, 37, 900))}
    for name, lines in want.items():
        (tmp_path / name).write_text("".join(line + "\n" for line in lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "50")
        got = array_text.lines(spark, str(tmp_path)).collect()
        assert len({(r.file, r.block) for r in got}) > 10
        rows = array_text.rows(spark, str(tmp_path / "f4.txt"), separator=":", ndim=3).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    made = {}
    for r in got:
        made.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.value
    assert {f: [d[i] for i in range(len(d))] for f, d in made.items()} == {f: v for f, v in want.items() if v}
    # the row of an array goes on from split to split
    assert sorted(r.row for r in rows) == list(range(900)) and {tuple(r["index"]) for r in rows} == {(4,)}


TEXT = """title line that is skipped
# comment
0 0  1.5 2.5 # after
0 0  -3 4e2


0 1  7 x
   # more
1 0  8
1 0  9 10 11
"""


@pytest.mark.parametrize("pack, end", [(lambda b: b, "txt"), (gzip.compress, "gz"), (bz2.compress, "bz2")])
def test_ragged_text_arrays(spark, tmp_path, pack, end):
    (tmp_path / f"a.{end}").write_bytes(pack(TEXT.encode()))
    get = lambda **k: sorted((r.dataset, tuple(r["index"]), r.row, tuple(r["values"])) for r in array_text.rows(spark, str(tmp_path), skip=1, **k).collect())
    assert get(ndim=4) == [(0, (0, 0), 0, (1.5, 2.5)), (0, (0, 0), 1, (-3.0, 400.0)), (0, (0, 1), 0, (7.0, None)), (0, (1, 0), 0, (8.0,)), (0, (1, 0), 1, (9.0, 10.0, 11.0))]
    assert get(ndim=2, parted=True)[2:] == [(1, (), 0, (0.0, 1.0, 7.0, None)), (1, (), 1, (1.0, 0.0, 8.0)), (1, (), 2, (1.0, 0.0, 9.0, 10.0, 11.0))]
    assert get(ndim=3, columns=[1, 2])[0] == (0, (0,), 0, (1.5,))
    cells = array_text.cells(array_text.rows(spark, str(tmp_path), ndim=4, skip=1))
    assert cells.count() == 10 and cells.where("v IS NULL").count() == 1


NAMES = ["a_z001_t02_w1.tif", "a_z002_t02_w1.tif", "a_z001_t03_w1.tif", "a_z001_t03_w1.png", "b-c2-Z5.tif", "m_0_DAPI_0.tif", "m_0_GFP_0.tif", "m_1_GFP_0.tif", "plain.tif"]


def test_series_and_their_gaps(spark, tmp_path):
    found = series.manifest(spark.createDataFrame([(f"/x/{n}", 1) for n in NAMES] + [(None, 2)], "path string, t int"))
    rows = {r.path[3:]: (r.series, r.t, r.w, r.z) for r in found.collect()}
    assert rows == {
        "a_z001_t02_w1.tif": ("/x/a", 2, 1, 1), "a_z002_t02_w1.tif": ("/x/a", 2, 1, 2), "a_z001_t03_w1.tif": ("/x/a", 3, 1, 1), "a_z001_t03_w1.png": ("/x/a", 3, 1, 1),
        "b-c2-Z5.tif": ("/x/b", 0, 2, 5), "m_0_DAPI_0.tif": ("/x/m", 0, 0, 0), "m_0_GFP_0.tif": ("/x/m", 0, 1, 0), "m_1_GFP_0.tif": ("/x/m", 1, 1, 0),
    }
    assert sorted(map(tuple, series.missing(found).collect())) == [("/x/a", 3, 1, 2), ("/x/m", 1, 0, 0)]
    assert [tuple(r) for r in series.repeated(found).collect()] == [("/x/a", 3, 1, 1, 2)]
    assert sorted(map(tuple, series.shapes(found).collect())) == [("/x/a", 2, 1, 2, 4), ("/x/b", 1, 1, 1, 1), ("/x/m", 2, 2, 1, 3)]
    for n in NAMES[:3]:
        (tmp_path / n).write_bytes(b"x")
    assert series.manifest(series.files(spark, str(tmp_path))).count() == 3


def test_marked_names_meet_no_labels_and_names_are_parsed_once(spark):
    """A name's parts are found in one place of the plan, not again in its filters; only names without marks go through the join."""
    found = series.manifest(spark.createDataFrame([(f"/x/{n}",) for n in NAMES], "path string"))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Union" in lines[0]
    marked = lines[1 : next(i for i, line in enumerate(lines) if "Join" in line)]
    assert any("Generate" in line for line in marked)
    assert not [line for line in marked if "Filter" in line and "regexp" in line]


def test_gaps_parse_names_once(spark):
    """The axes and the look for gaps read stored places, no names."""
    found = series.manifest(spark.createDataFrame([(f"/x/{n}",) for n in NAMES], "path string"))
    assert "regexp" not in series.missing(found)._jdf.queryExecution().optimizedPlan().toString()


def test_odd_names_of_series(spark):
    names = ["/x/a_1_b_2_z3.tif", "/x/a_1_b_2.tif", "/x/a_1_c_2", "/x/a_1_b.c_2", "/x/d_z99999999999.tif", "/x/d_0_e_99999999999999999999.tif", "/x/f_5_g_6_z99999999999.tif", "/y\nz/a_t1-t02.tif", "h-Z1_C2.x_z7", "/z1/x_z9/no.tif", "/x/i_3_k_4\n.tif", "/x/.z_z1", ""]
    found = series.manifest(spark.createDataFrame([(n,) for n in names], "path string"))
    assert {r.path: (r.series, r.t, r.w, r.z) for r in found.collect()} == {
        "/x/a_1_b_2_z3.tif": ("/x/a_1_b_2", 0, 0, 3), "/x/a_1_b_2.tif": ("/x/a", 1, 0, 2), "/x/a_1_c_2": ("/x/a", 1, 1, 2), "/x/d_0_e_99999999999999999999.tif": ("/x/d", 0, 0, 0),
        "/y\nz/a_t1-t02.tif": ("/y\nz/a", 2, 0, 0), "h-Z1_C2.x_z7": ("h", 0, 2, 7), "/x/i_3_k_4\n.tif": ("/x/i\n", 3, 0, 4), "/x/.z_z1": ("/x/.z", 0, 0, 1),
    }


def spline(values, x):
    """By the whole system of equations."""
    n = len(values)
    a = np.zeros((n, n))
    mirror = lambda i: abs(i) if i < n else 2 * (n - 1) - i
    for i in range(n):
        for j, w in ((i - 1, 1), (i, 4), (i + 1, 1)):
            a[i, mirror(j)] += w
    c = np.linalg.solve(a, 6 * np.array(values))
    b = lambda d: (4 - 6 * d**2 + 3 * d**3) / 6 if d < 1 else (2 - d) ** 3 / 6 if d < 2 else 0.0
    return [sum(c[mirror(j)] * b(abs(v - j)) for j in range(int(v) - 1, int(v) + 3) if -n < j < 2 * n - 1) for v in x]


@pytest.mark.parametrize("n, m", [(1, 4), (2, 5), (3, 7), (9, 30), (9, 9), (9, 4), (40, 41)])
def test_parameters_over_frames(spark, n, m):
    rng = np.random.default_rng(n)
    rows = [(w, t, float(rng.normal()), float(rng.normal())) for w in range(3) for t in range(n)]
    made = frames.over_frames(spark.createDataFrame(rows, "w int, t long, ty double, name double").repartition(4), m, ["ty", "name"], "w")
    got = {(r.w, r.t): (r.ty, r.name) for r in made.collect()}
    assert len(got) == 3 * m
    for w in range(3):
        for k in (0, 1):
            f = [r[2 + k] for r in rows if r[0] == w]
            want = f[:m] if n >= m else f * m if n == 1 else spline(f, [i * (n - 1) / (m - 1) for i in range(m)])
            assert [got[w, t][k] for t in range(m)] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("n, m", [(1, 4), (2, 5), (3, 7), (9, 30), (9, 9), (9, 4), (130, 41)])
def test_parameters_at_more_or_fewer_places(spark, n, m):
    rng = np.random.default_rng(n)
    rows = [(w, t, float(rng.normal()), float(rng.normal())) for w in range(3) for t in range(n)]
    made = frames.resampled(spark.createDataFrame(rows, "w int, t long, ty double, name double").repartition(4), m, ["ty", "name"], "w")
    got = {(r.w, r.t): (r.ty, r.name) for r in made.collect()}
    assert len(got) == 3 * m
    for w in range(3):
        for k in (0, 1):
            f = [r[2 + k] for r in rows if r[0] == w]
            want = f * m if n == 1 else spline(f, [i * (n - 1) / (m - 1) for i in range(m)])
            assert [got[w, t][k] for t in range(m)] == pytest.approx(want, abs=1e-9)


def test_windows_round_points(spark):
    a = np.arange(4 * 20 * 15, dtype=float).reshape(4, 20, 15)
    size = 6
    blocks = [("i", z, y // size, x // size, *a[z, y : y + size, x : x + size].shape, a[z, y : y + size, x : x + size].ravel().tolist()) for z in range(4) for y in range(0, 20, size) for x in range(0, 15, size)]
    points = [("i", 1, 1.0, 9.0, 7.5), ("i", 2, 0.0, 0.0, 0.0), ("i", 3, 3.9, 19.9, 14.2), ("i", 4, 50.0, 5.0, 5.0), ("i", 5, -9.0, 5.0, 5.0), ("j", 6, 1.0, 1.0, 1.0), ("i", 7, 1.0, 9.0, 7.5)]
    made = cutouts.cut_out(spark.createDataFrame([(*p, 0) for p in points], "image string, id int, pz double, py double, px double, z int"), spark.createDataFrame(blocks, "image string, z int, by int, bx int, ny int, nx int, data array<double>"), size, (3, 8, 5), "image")
    got = {r.id: r for r in made.collect()}
    assert set(got) == {1, 2, 3, 7}
    for i, r in got.items():
        p = next(p[2:] for p in points if p[1] == i)
        at = [int(np.ceil(c - w / 2)) for c, w in zip(p, (3, 8, 5))]
        part = a[tuple(slice(max(s, 0), max(s + w, 0)) for s, w in zip(at, (3, 8, 5)))]
        assert (r.nz, r.ny, r.nx) == part.shape and r.data == part.ravel().tolist() and (r.z0, r.y0, r.x0) == tuple(max(s, 0) for s in at)


PARAMETERS = """nt,2
nw,2
pxlsize_z_y_x,0.2,0.1,0.05
refwave,1
t,wavelength,tz,ty,tx,r,mz,my,mx
0,488.0,1,2,-3,0.5,1,1.01,0.99
0,561.0,0,0,0,0,1,1,1
1,488.0,0,2,0,0,1,1,1
1,561.0,0,1,0,0,1,1,1
"""


def test_parameter_files_and_their_summary(spark, tmp_path):
    (tmp_path / "a.csv").write_text(PARAMETERS)
    (tmp_path / "b.csv").write_text(PARAMETERS.replace("refwave,1", "refwave,0").replace("pxlsize_z_y_x,0.2,0.1,0.05", "pxlsize,0.2,0.1,0.05"))
    assert {tuple(r)[1:] for r in param_files.headers(spark, str(tmp_path)).collect()} == {(2, 2, 0.2, 0.1, 0.05, 1), (2, 2, 0.2, 0.1, 0.05, 0)}
    rows = {(r.file[-5:], r.time): r for r in reports.summary(spark, str(tmp_path), (10, 200, 100)).collect()}
    assert set(rows) == {("a.csv", 0), ("a.csv", 1), ("b.csv", 0), ("b.csv", 1)} and rows["a.csv", 0].wave == 488.0 and rows["b.csv", 0].wave == 561.0
    r, c = rows["a.csv", 0], np.radians(0.5)
    way = np.hypot(100 * np.cos(c) + 50 * np.sin(c) - 100, 50 * np.cos(c) - 100 * np.sin(c) - 50) * 75
    assert (r.tz, r.ty, r.tx, r.r, r.mz, r.my, r.mx) == pytest.approx((200, 200, -150, way, 0, 100, 25))
    assert r.total == pytest.approx(np.sqrt(200**2 + 200**2 + 150**2 + way**2 + 100**2 + 25**2))
    assert rows["b.csv", 1].ty == pytest.approx(-100)


def test_tables_of_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,value,"a, b"\n"x, ""y""",1.5,3\nshort\n\nlong,2,3,4\n')
    (tmp_path / "b.csv").write_text("Value,Name,Name\n7,first,last\nbad,,z\n")
    (tmp_path / "c.csv").write_text("name\n")
    rows = reports.chosen(reports.tables(spark, str(tmp_path)), name=("string", ["name", "Name"]), value=("double", ["value", "Value"]), other=("int", ["a, b"])).collect()
    assert sorted((r.file[-5:], r.line, r.name, r.value, r.other) for r in rows) == [
        ("a.csv", 1, 'x, "y"', 1.5, 3), ("a.csv", 2, "short", None, None), ("a.csv", 4, "long", 2.0, 3), ("b.csv", 1, "last", 7.0, None), ("b.csv", 2, "z", None, None),
    ]
