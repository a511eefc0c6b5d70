"""Image files read and written by byte range."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from planecraft.sources import image_files, section_files


@pytest.fixture(scope="module")
def planes(spark):
    rows = []
    rng = np.random.default_rng(3)
    for file, (nt, nw, nz, kind) in {"a.mrc": (2, 3, 4, "int16"), "b.mrc": (1, 1, 7, "float32"), "c.mrc": (3, 7, 1, "uint8")}.items():
        for t in range(nt):
            for w in range(nw):
                for z in range(nz):
                    data = rng.integers(0, 200, 30) + (1000 if kind == "int16" and z == 2 else 0)
                    rows.append((file, t, w, z, 5, 6, kind, 400.0 + 10 * w, 0.2, 0.1, 0.05, [float(v) for v in data], "x"))
    return spark.createDataFrame(rows, "file string, t long, w long, z long, ny int, nx int, dtype string, wave double, pz double, py double, px double, data array<double>, nz string").repartition(5)


def rows(df):
    return sorted((os.path.basename(r.file), r.t, r.w, r.z, r.ny, r.nx, r.dtype, tuple(r.data)) for r in df.collect())


@pytest.mark.parametrize("order", ["ZTW", "WZT", "ZWT"])
def test_round_trip_and_splits(spark, planes, tmp_path, order):
    path = f"file://{tmp_path}/made"
    section_files.write(planes.drop("nz"), path, order)
    want = rows(planes)
    for split in (1 << 20, 100, 17):
        assert rows(section_files.read(spark, path, splitbytes=split)) == want
    first = section_files.read(spark, path, glob="a*").where("w = 2").first()
    assert (first.wave, first.pz, first.py, first.px) == pytest.approx((420.0, 0.2, 0.1, 0.05))
    assert os.listdir(tmp_path / "made") and not [n for n in os.listdir(tmp_path / "made") if n.startswith("_")]
    # the older reader of whole files sees the same sections
    raw = (tmp_path / "made" / "b.mrc").read_bytes()
    assert np.array_equal(image_files.mrc_planes(raw)[0].reshape(7, 30), [r[-1] for r in want if r[0] == "b.mrc"])


def test_filters_are_pushed(spark, planes, tmp_path, capsys):
    path = f"file://{tmp_path}/made"
    section_files.write(planes.drop("nz"), path)
    some = section_files.read(spark, path).where("z >= 2 AND w IN (0, 2) AND t = 1")
    some.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "GreaterThanOrEqual(z,2)" in plan.replace(" ", "")
    assert rows(some) == [r for r in rows(planes) if r[3] >= 2 and r[2] in (0, 2) and r[1] == 1]
    bright = section_files.read(spark, path).where("v_max >= 1000 AND v_min < 1100")
    assert rows(bright) == [r for r in rows(planes) if max(r[-1]) >= 1000 and min(r[-1]) < 1100]
    assert section_files.read(spark, path).where("v_max IS NULL OR z > 100").count() == 0


def test_sections_that_cannot_match_are_not_read(spark, planes, tmp_path):
    """Pixels of dark sections are spoilt after writing: a query for bright ones doesn't notice."""
    path = f"file://{tmp_path}/made"
    section_files.write(planes.where("file = 'a.mrc'").drop("nz"), path)
    want = rows(section_files.read(spark, path).where("v_max >= 1000"))
    layout = section_files.mrc_layout((tmp_path / "made" / "a.mrc").read_bytes()[:1024])
    with open(tmp_path / "made" / "a.mrc", "r+b") as f:
        for i in range(layout.n):
            if i % 4 != 2:
                f.seek(layout.offset(i))
                f.write(b"\xff\x7f" * 30)
    assert rows(section_files.read(spark, path).where("v_max >= 1000")) == want and len(want) == 6
    index = section_files.read(spark, path, data=False)
    assert index.where("v_max >= 1000").count() == 6 and index.where("data IS NOT NULL").count() == 0 and index.count() == 24


def test_a_large_file_is_read_by_range(spark, tmp_path):
    """3 GB, nearly all of it a hole: three sections come from three reads."""
    layout = section_files.Layout("<u1", 1024, 1024, (1, 1, 3072))
    with open(tmp_path / "big.mrc", "wb") as f:
        f.write(section_files.mrc_header(layout, "ZTW", 0, 0, 0, 0))
        f.seek(layout.offset(2000))
        f.write(bytes([7]) * 1024)
        f.truncate(layout.offset(3072))
    some = section_files.read(spark, f"file://{tmp_path}/big.mrc").where("z BETWEEN 1999 AND 2001")
    assert sorted((r.z, r.v_max, r.total) for r in some.select("z", "v_max", F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total")).collect()) == [(1999, 0.0, 0.0), (2000, 7.0, 7168.0), (2001, 0.0, 0.0)]
    assert some.rdd.getNumPartitions() == 49


def test_a_failed_task_leaves_no_damage(spark, planes, tmp_path):
    path = f"file://{tmp_path}/made"
    section_files.write(planes.drop("nz"), path)
    before = {n: (tmp_path / "made" / n).read_bytes() for n in os.listdir(tmp_path / "made")}
    broken = planes.drop("nz").withColumn("data", F.when((F.col("file") == "c.mrc") & (F.col("t") == 2), F.array(F.lit(1.0))).otherwise(F.transform("data", lambda v: v + 1)))
    with pytest.raises(Exception, match="another size"):
        section_files.write(broken, path)
    assert {n: (tmp_path / "made" / n).read_bytes() for n in os.listdir(tmp_path / "made")} == before
    missing = planes.drop("nz").where("NOT (file = 'a.mrc' AND t = 1 AND w = 0 AND z = 0)")
    double = planes.drop("nz").union(planes.drop("nz").where("file = 'b.mrc' AND z = 1"))
    for wrong in (missing, double):
        with pytest.raises(Exception, match="is wanted once"):
            section_files.write(wrong, path)
        assert {n: (tmp_path / "made" / n).read_bytes() for n in os.listdir(tmp_path / "made")} == before


def test_other_formats_and_broken_files(spark, tmp_path):
    pages = [np.arange(12, dtype="<u2").reshape(3, 4) + 100 * k for k in range(5)]
    (tmp_path / "p.tif").write_bytes(image_files.tiff_bytes(pages))
    np.save(tmp_path / "n.npy", np.arange(120, dtype=">f8").reshape(2, 5, 3, 4))
    got = rows(section_files.read(spark, f"file://{tmp_path}", splitbytes=64))
    assert [r[-1] for r in got if r[0] == "p.tif"] == [tuple(map(float, p.ravel())) for p in pages]
    assert [(r[2], r[3], r[-1][0]) for r in got if r[0] == "n.npy"] == [(w, z, 60.0 * w + 12 * z) for w in range(2) for z in range(5)]
    raw = bytearray(section_files.mrc_header(section_files.Layout("<i2", 4, 4, (1, 1, 9)), "ZTW", 0, 0, 0, 0))
    (tmp_path / "short.mrc").write_bytes(raw + b"\0" * 40)
    with pytest.raises(Exception, match="ends before"):
        section_files.read(spark, f"file://{tmp_path}/short.mrc").collect()
    struct.pack_into("<i", raw, 12, 99)
    (tmp_path / "short.mrc").write_bytes(raw)
    with pytest.raises(Exception, match="known type"):
        section_files.read(spark, f"file://{tmp_path}/short.mrc").collect()


def test_files_are_converted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pages = [np.arange(12, dtype="<u2").reshape(3, 4) + 100 * k for k in range(5)]
    (tmp_path / "in" / "p.q.tif").write_bytes(image_files.tiff_bytes(pages))
    np.save(tmp_path / "in" / "n.npy", np.arange(120, dtype="f8").reshape(2, 5, 3, 4))
    section_files.convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = rows(section_files.read(spark, f"file://{tmp_path}/out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["n.mrc", "p.q.mrc"] and {(r[0], r[6]) for r in got} == {("n.mrc", "float32"), ("p.q.mrc", "uint16")}
    assert [r[-1] for r in got if r[0] == "p.q.mrc"] == [tuple(map(float, p.ravel())) for p in pages] and [r[2:4] for r in got if r[0] == "n.mrc"] == [(w, z) for w in range(2) for z in range(5)]


def test_files_may_lack_sections(spark, planes, tmp_path):
    path = f"file://{tmp_path}/made"
    some = planes.drop("nz").where("NOT (file = 'a.mrc' AND t = 1 AND (w = 0 AND z = 0 OR z = 3))")
    section_files.write(some, path, gaps=True)
    for split in (1 << 20, 700):
        assert rows(section_files.read(spark, path, splitbytes=split)) == rows(some)
    assert rows(section_files.read(spark, path).where("z = 3 AND v_min >= 0")) == [r for r in rows(some) if r[3] == 3]
    assert section_files.read(spark, path, data=False).count() == some.count()
    assert (tmp_path / "made" / "a.mrc").stat().st_size == 1024 + 24 * (32 + 60)  # whole for other readers
    with pytest.raises(Exception, match="is wanted once"):
        section_files.write(some.union(some.where("file = 'a.mrc' AND t = 0 AND z = 1")), path, gaps=True)


def test_small_files_share_a_task(spark, tmp_path):
    made = spark.range(300).selectExpr("concat(id div 2, '.mrc') AS file", "0L AS t", "0L AS w", "id % 2 AS z", "1 AS ny", "2 AS nx", "'float32' AS dtype", "488D AS wave", "1D AS pz", "1D AS py", "1D AS px", "array(double(id), 0D) AS data")
    section_files.write(made, f"file://{tmp_path}/made")
    read = section_files.read(spark, f"file://{tmp_path}/made")
    assert read.rdd.getNumPartitions() <= 10 and sorted(r.data[0] for r in read.collect()) == list(range(300))
