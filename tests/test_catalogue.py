"""Every query against its SQL in DuckDB, and the kernels against known shifts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from planecraft.operators import kernels, params
from planecraft.plans import catalogue
from planecraft.sources import param_files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[table[n].to_pylist() for n in names]), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf).toArrow(), con.sql(catalogue.ORACLES[name]).to_arrow_table()
    assert rows(got) == rows(want) and len(got)


ROWS = {"phase_correlation": 500, "global_alignment": 7, "mosaic_peaks": 35, "time_drift": 56, "registration_report": 28, "tile_loop_shifts": 343}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_kernel_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() == ROWS[name]


def test_known_warps_of_mosaics_are_found(spark, sf):
    for r in catalogue.QUERIES["global_alignment"](spark, sf).collect():
        assert (r.ty, r.tx, r.r) == pytest.approx((1.5, -2.0, 0.6), abs=0.25)


def test_a_known_shift_of_mosaics_is_found_by_tiles(spark, sf):
    rows = [r for r in catalogue.QUERIES["tile_loop_shifts"](spark, sf).collect() if r.accepted and 8 <= r.y0 <= 40 and 8 <= r.x0 <= 40]
    assert len(rows) > 100 and np.median([r.dy for r in rows]) == pytest.approx(1.5, abs=0.2) and np.median([r.dx for r in rows]) == pytest.approx(-2.0, abs=0.2)


def test_the_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_phase_correlation_matches_a_direct_transform(spark, sf):
    """Each query row against sums over all pairs of frequencies and pixels."""
    planes = {r.z: (r.w, np.array(r.data).reshape(8, 8)) for r in catalogue.sections(spark, sf).collect()}
    first = {}
    for z in sorted(planes, reverse=True):
        first[planes[z][0]] = planes[z][1]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(8), np.arange(8)) / 8)
    for r in catalogue.QUERIES["phase_correlation"](spark, sf).collect():
        w, b = planes[r.z]
        cross = (turn @ first[w] @ turn.T) * np.conj(turn @ b @ turn.T)
        image = (np.conj(turn) @ (cross / np.maximum(np.abs(cross), 1e-12)) @ np.conj(turn).T).real / 64
        assert r.height == pytest.approx(image.max(), abs=1e-9)


def test_phase_shift_finds_rolls():
    plane = np.random.default_rng(4).normal(size=(64, 48))
    for dy, dx in ((0, 0), (3, -5), (-20, 11)):
        found = kernels.phase_shift(plane, np.roll(plane, (dy, dx), (0, 1)))
        assert found[:2] == pytest.approx((dy, dx), abs=0.2) and found[2] > 0.9


def test_affine_identity_and_shift():
    plane = np.arange(30.0).reshape(5, 6)
    assert np.allclose(kernels.affine(plane, 0, 0, 0, 1, 1), plane)
    moved = kernels.affine(plane, 1, 0, 0, 1, 1)
    assert np.allclose(moved[1:], plane[:-1]) and not moved[0].any()


def test_inverse_composes_to_identity(spark, sf):
    p = catalogue.parameters(spark, sf)
    both = params.composed(p, params.inverted(p)).toPandas()
    assert np.allclose(both[list(params.SHIFTS)], 0, atol=1e-5) and np.allclose(both[list(params.ZOOMS)], 1, atol=1e-5)


def test_param_file_round_trip(spark, tmp_path):
    made = spark.createDataFrame([(t, 488.0 + 73 * w, 0.5 * t, 1.0, -2.0, 0.1, 1.0, 1.01, 0.99) for t in range(2) for w in range(3)], ["t", "wavelength", *params.NAMES])
    path = str(tmp_path / "params")
    param_files.lines(made, 0, (0.2, 0.08, 0.08)).write.text(path)
    text = [r.value for r in spark.read.text(path).collect()]
    assert text[:2] == ["nt,2", "nw,3"] and text[4].startswith("t,wavelength,tz")
    assert sorted(map(tuple, param_files.read(spark, path).drop("file").collect())) == sorted(map(tuple, made.collect()))
