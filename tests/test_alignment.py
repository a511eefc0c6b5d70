"""Whole images: reference channels, averages, and alignment from files to files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from planecraft import align
from planecraft.operators import alignment, kernels
from planecraft.sources import param_files, section_files

COLUMNS = "file string, t long, w long, z long, ny int, nx int, dtype string, wave double, pz double, py double, px double, data array<double>"


def scene(nz, n, seed):
    rng = np.random.default_rng(seed)
    z, y, x = np.mgrid[:nz, :n, :n].astype(float)
    a = np.zeros((nz, n, n))
    for cz, cy, cx in rng.uniform(0, 1, (260, 3)) * (nz, n, n):
        a += 3000 * np.exp(-((z - cz) ** 2) / 4 - ((y - cy) ** 2 + (x - cx) ** 2) / 8)
    return a


#: By channel: shift along z in sections, and what brings the channel back in its plane.
TRUE = {0: (0, (0, 0, 0, 1, 1)), 1: (0, (0, 0, 0, 1, 1)), 2: (1, (1.5, -2.0, 0.4, 1, 1))}


def image(spark, file, nz, n, seed):
    a, rows = scene(nz, n, seed), []
    for w, (tz, p) in TRUE.items():
        away = (-p[0], -p[1], -p[2], 1, 1)
        b = np.roll(a, -tz, 0)
        for z in range(nz):
            plane = np.clip(np.rint(kernels.affine(b[z], *away)), 0, 65535) if w == 2 else np.rint(b[z])
            rows.append((file, 0, w, z, n, n, "uint16", 450.0 + 70 * w, 0.2, 0.1, 0.1, np.rint(plane * (1.0, 1.3, 1.1)[w]).ravel().tolist()))
    return spark.createDataFrame(rows, COLUMNS)


def test_from_files_to_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    section_files.write(image(spark, "beads.mrc", 12, 96, 1), f"{root}/references")
    section_files.write(image(spark, "cells.mrc", 12, 96, 2), f"{root}/targets")
    align.run(spark, [f"{root}/targets"], [f"{root}/references"], f"{root}/out")
    found = {r.wavelength: r for r in param_files.read(spark, f"{root}/out/parameters").collect()}
    head = param_files.headers(spark, f"{root}/out/parameters").first()
    assert (head.nt, head.nw, head.reference) == (1, 3, 1) and head.pz == pytest.approx(0.2) and "file=beads.mrc" in head.file
    r = found[590.0]
    assert (r.ty, r.tx, r.r) == pytest.approx((1.5, -2.0, 0.4), abs=0.15) and r.tz == pytest.approx(1, abs=0.3) and (r.my, r.mx) == pytest.approx((1, 1), abs=0.01)
    assert [found[520.0][c] for c in ("tz", "ty", "tx", "r", "mz", "my", "mx")] == [0, 0, 0, 0, 1, 1, 1]

    def pearson(path):
        s = {}
        for r in section_files.read(spark, path).where("z BETWEEN 3 AND 8").collect():
            s.setdefault(r.w, {})[r.z] = np.array(r.data).reshape(r.ny, r.nx)[6:-6, 6:-6]
        a, b = (np.concatenate([s[w][z].ravel() for z in sorted(s[w])]) for w in (1, 2))
        return np.corrcoef(a, b)[0, 1]

    assert os.listdir(tmp_path / "out" / "images") == ["cells_aligned.mrc"]
    assert pearson(f"{root}/targets") < 0.75 and pearson(f"{root}/out/images") > 0.97
    made = section_files.read(spark, f"{root}/out/images").first()
    assert made.dtype == "uint16" and made.ny < 96 and made.nx < 96
    # the saved parameters do as well as the image they come from
    align.run(spark, [f"{root}/targets"], [f"{root}/out/parameters"], f"{root}/again")
    assert (tmp_path / "again" / "images" / "cells_aligned.mrc").read_bytes() == (tmp_path / "out" / "images" / "cells_aligned.mrc").read_bytes()


def planes(spark, *channels):
    return spark.createDataFrame([("a", 0, w, z, 1, 2, kind, float(wave), 1.0, 1.0, 1.0, [float(v), float(v)]) for w, (wave, v, kind) in enumerate(channels) for z in range(2)], COLUMNS)


@pytest.mark.parametrize("channels, want", [
    ([(400, 1, "uint8"), (500, 9, "uint8")], 0), ([(400, 50, "uint8"), (500, 41, "uint8"), (600, 60, "uint8")], 1), ([(400, 50, "uint8"), (500, 255, "uint8"), (600, 60, "uint8")], 1),
    ([(400, 50, "uint8"), (500, 20, "uint8"), (600, 60, "uint8")], 2), ([(450, 50, "float32"), (400, 50, "float32"), (500, 55, "float32"), (480, 55, "float32")], 3),
])
def test_reference_channels(spark, channels, want):
    assert [(r.file, r.w) for r in alignment.best_channels(planes(spark, *channels)).collect()] == [("a", want)]


def test_averages(spark):
    one, two = image(spark, "a.mrc", 4, 8, 1), image(spark, "b.mrc", 6, 8, 2)
    made = {(r.w, r.z): r.data for r in alignment.averaged(one.union(two), "m").collect()}
    get = lambda d: {(r.w, r.z): np.array(r.data) for r in d.collect()}
    a, b = get(one), get(two)
    assert len(made) == 12 and all(np.allclose(made[w, z], (a[w, z] + b[w, z + 1]) / 2) for w, z in made)
    with pytest.raises(Exception, match="differ"):
        alignment.averaged(one.union(two.where("w < 2")), "m").collect()


def test_unmatched_waves_stay(spark):
    own = planes(spark, (400, 10, "float32"), (500, 20, "float32"))
    p = spark.createDataFrame([(0, 700.0, *[9.0] * 7)], "t long, wave double, tz double, ty double, tx double, r double, mz double, my double, mx double")
    got = alignment.applied(own, p)
    assert sorted(map(str, got.collect())) == sorted(map(str, own.collect()))
    assert alignment.applied(own.where(F.lit(False)), p).collect() == []
