"""Images in blocks against whole images, and holes of grids against the definition."""

import numpy as np
import pytest

from planecraft.operators import blocks, holes


def scene(ny, nx):
    y, x = np.mgrid[:ny, :nx]
    return np.sin(y / 7.0) * np.cos(x / 11.0) + (y * 31 + x * 17) % 101 / 50


def direct(a, weights):
    half, n = len(weights) // 2, len(weights)
    p = np.pad(a, half, "edge")
    down = sum(k * p[i : i + a.shape[0]] for i, k in enumerate(weights))
    return sum(k * down[:, i : i + a.shape[1]] for i, k in zip(range(n), weights))


@pytest.mark.parametrize("shape", [(4096, 4096), (100, 70), (32, 32), (65, 33)])
def test_blocks_equal_the_whole_image(spark, shape):
    a = scene(*shape)
    size = 512 if shape[0] > 1000 else 32
    tiles = [(0, y // size, x // size, *a[y : y + size, x : x + size].shape, a[y : y + size, x : x + size].ravel().tolist()) for y in range(0, shape[0], size) for x in range(0, shape[1], size)]
    table = spark.createDataFrame(tiles, "image int, by int, bx int, ny int, nx int, data array<double>").repartition(8)
    for made, want in (
        (blocks.smoothed(table, blocks.gaussian(1.0), "image"), direct(a, blocks.gaussian(1.0))),
        (blocks.gradient(table, "image"), np.hypot(*[(np.roll(np.pad(a, 1, "edge"), -1, i) - np.roll(np.pad(a, 1, "edge"), 1, i))[1:-1, 1:-1] / 2 for i in (0, 1)])),
    ):
        got = np.full(shape, np.nan)
        for r in made.toLocalIterator():
            got[r.by * size : r.by * size + r.ny, r.bx * size : r.bx * size + r.nx] = np.reshape(r.data, (r.ny, r.nx))
        assert np.allclose(got, want, atol=1e-12)


def test_cut_and_whole(spark):
    a = scene(50, 37)
    plane = spark.createDataFrame([(3, 50, 37, a.ravel().tolist()), (4, 5, 7, list(map(float, range(35))))], "z int, ny int, nx int, data array<double>")
    parts = blocks.cut(plane, 16, "z")
    assert parts.count() == 4 * 3 + 1
    back = {r.z: (r.ny, r.nx, r.data) for r in blocks.whole(parts, "z").collect()}
    assert back == {r.z: (r.ny, r.nx, r.data) for r in plane.collect()}


def test_missing_blocks_and_no_rows(spark):
    made = spark.createDataFrame([(0, 0, 0, 2, 2, [1.0, 2.0, 3.0, 4.0]), (0, 5, 5, 2, 2, [9.0] * 4), (None, 0, 0, 1, 1, [5.0])], "image int, by int, bx int, ny int, nx int, data array<double>")
    got = {(r.image, r.by): r.data for r in blocks.smoothed(made, [1 / 3] * 3, "image").collect()}
    assert got[0, 5] == pytest.approx([9.0] * 4) and got[None, 0] == pytest.approx([5.0])
    assert got[0, 0] == pytest.approx(direct(np.array([[1.0, 2], [3, 4]]), [1 / 3] * 3).ravel())
    assert blocks.gradient(made.where("false"), "image").collect() == []


def filled(shift, good):
    """The definition, tile by tile."""
    good, shift, r = good.copy(), shift.copy(), 0
    rounds = np.where(good, 0, -1)
    ni, nj = good.shape
    while good.any() and not good.all():
        r += 1
        new, made = good.copy(), shift.copy()
        for i, j in zip(*np.nonzero(~good)):
            up, down = (0, r) if i < r else (r, 0 if i > ni - r else r)
            left, right = (0, r) if j < r else (r, 0 if j > nj - r else r)
            near = [(a, b) for a in range(max(i - up, 0), min(i + down + 1, ni)) for b in range(max(j - left, 0), min(j + right + 1, nj)) if good[a, b]]
            if near:
                made[:, i, j] = np.mean([shift[:, a, b] for a, b in near], 0) / 2 ** (r - 1)
                new[i, j], rounds[i, j] = True, r
        good, shift = new, made
    return shift, rounds


@pytest.mark.parametrize("share", [0.02, 0.3, 1.0, 0.0])
def test_holes_are_filled_as_defined(spark, share):
    rng = np.random.default_rng(5)
    ni, nj = 13, 9
    good, shift = rng.random((ni, nj)) < share, rng.normal(size=(2, ni, nj))
    if share == 0.02:
        good[:] = False
        good[4, 7] = True
    rows = [(1, i, j, float(shift[0, i, j]), float(shift[1, i, j]), bool(good[i, j]), "x") for i in range(ni) for j in range(nj)]
    got = holes.fill(spark.createDataFrame(rows, "z long, i long, j long, dy double, dx double, accepted boolean, ni string").repartition(3), "z").collect()
    want, rounds = filled(shift, good)
    assert len(got) == ni * nj
    for r in got:
        assert (r.dy, r.dx) == pytest.approx(tuple(want[:, r.i, r.j]), abs=1e-12)
        assert (-1 if r.round is None else r.round) == rounds[r.i, r.j]


def test_sparse_grids_and_odd_values(spark):
    """No join for each round is left: one plan deals the tiles to their planes, whatever their number."""
    nan = float("nan")
    rows = [(1, 0, 0, 2.0, 1.0, True), (1, 0, 1, nan, 0.0, False), (1, 5, 0, 7.0, None, True), (1, 5, 1, 0.0, 3.0, None), (2, 0, 0, nan, 1.0, True), (2, 0, 1, 5.0, 5.0, False), (3, 0, 0, 9.0, 9.0, False)]
    made = holes.fill(spark.createDataFrame(rows, "z long, i long, j long, dy double, dx double, accepted boolean"), "z")
    assert "Join" not in made._jdf.queryExecution().toString()
    got = {(r.z, r.i, r.j): (None if r.dy != r.dy else r.dy, r.dx, r.round) for r in made.collect()}
    assert got == {(1, 0, 0): (2.0, 1.0, 0), (1, 0, 1): (2.0, 1.0, 1), (1, 5, 0): (7.0, None, 0), (1, 5, 1): (7.0, None, 1), (2, 0, 0): (None, 1.0, 0), (2, 0, 1): (None, 1.0, 1), (3, 0, 0): (9.0, 9.0, None)}
