"""Fourier filters against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planecraft.operators import filters

A = np.random.default_rng(3).normal(size=(2, 8, 10))


def direct(a, gain):
    """Every frequency by itself: gain(fy, fx) times the plane's coefficient."""
    ny, nx = a.shape
    y, x = np.mgrid[:ny, :nx]
    out = np.zeros(a.shape, complex)
    for fy in range(-(ny // 2), ny - ny // 2):
        for fx in range(-(nx // 2), nx - nx // 2):
            wave = np.exp(2j * np.pi * (fy * y / ny + fx * x / nx))
            out += gain(fy, fx) * (a * np.conj(wave)).sum() * wave / a.size
    return out.real


def test_low_and_high_pass():
    wide = 8 / (2 * np.pi * 1.5)
    for plane, made in zip(A, filters.low_pass(A, 1.5)):
        assert made == pytest.approx(direct(plane, lambda fy, fx: np.exp(-(fy * fy + fx * fx) / (2 * wide * wide))))
    gain = lambda fy, fx: 0 if fy in (0, 1) or abs(fx) < 2 else 1 / (np.exp(-(fy * fy + fx * fx) / (2 * 2.5**2)) + 0.2)
    spectrum = np.fft.fft2(filters.high_pass(A, cut=2)[0])
    assert np.abs(spectrum[0]).max() < 1e-9 and np.abs(spectrum[:, :2]).max() < 1e-9
    own = np.fft.rfft2(A[0])
    assert np.fft.rfft2(filters.high_pass(A, cut=2)[0])[3, 3] == pytest.approx(own[3, 3] * gain(3, 3))


def test_convolution_and_hat():
    k = np.random.default_rng(1).normal(size=(8, 10))
    want = np.zeros((8, 10))
    for dy in range(8):
        for dx in range(10):
            want += k[dy, dx] * np.roll(A[0], (dy, dx), (0, 1))
    assert filters.convolved(A, k)[0] == pytest.approx(want)
    assert filters.convolved(A, A[0], True)[0].argmax() == 0
    point = np.zeros((1, 8, 8))
    point[0, 0, 0] = 64
    assert filters.mexican_hat(point, 1.0)[0, 0, 0] == pytest.approx(2 * 2 / np.sqrt(3) * np.pi**-0.25)


def test_shift_zoom_and_band_stop():
    assert filters.shifted(A, 2, -3) == pytest.approx(np.roll(A, (2, -3), (1, 2)))
    big = filters.zoomed(A, 16, 20)
    assert big.mean((1, 2)) == pytest.approx(A.mean((1, 2))) and filters.zoomed(big, 8, 10).shape == A.shape
    smooth = np.cos(2 * np.pi * np.arange(8) / 8)[None, :, None] * np.ones((1, 8, 10))
    assert filters.zoomed(smooth, 16, 20)[0, ::2, ::2] == pytest.approx(smooth[0])
    assert filters.band_stop(smooth, 2) == pytest.approx(smooth)
    size, angle = filters.size_and_phase(A)
    assert size[:, 4, 5] == pytest.approx(np.abs(A.sum((1, 2))))


def test_a_whole_batch_of_planes_is_not_worked_on_at_once(spark):
    """300 planes of 64 x 64 are 9.8 MB in one batch."""

    def most(a):
        assert a.nbytes <= 2 << 20, a.nbytes
        return a + 1

    data = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda p: (p + F.col("id")).cast("double"))
    planes = spark.range(300).coalesce(1).select(F.col("id").alias("z"), F.lit(0).alias("w"), F.lit(64).alias("ny"), F.lit(64).alias("nx"), data.alias("data"))
    made = filters.filtered(planes, most).select("z", F.size("data").alias("n"), F.get("data", F.lit(0)).alias("first"), F.get("data", F.lit(4095)).alias("last"))
    assert sorted(map(tuple, made.collect())) == [(z, 4096, z + 1.0, z + 4096.0) for z in range(300)]
