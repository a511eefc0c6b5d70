"""Fourier filters and polar views of planes, in numpy on the planes of an Arrow batch: those of one shape are transformed together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planecraft.operators.fitting import images, in_portions
from planecraft.operators.local import sampled
from planecraft.plans.shipping import ship


def frequencies(ny: int, nx: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole frequencies of the half spectrum, along y and x."""
    return np.fft.fftfreq(ny, 1 / ny)[:, None], np.fft.rfftfreq(nx, 1 / nx)[None, :]


def low_pass(a: np.ndarray, sigma: float) -> np.ndarray:
    """Planes (n, ny, nx) smoothed by a Gaussian of `sigma` pixels, as measured along y."""
    ny, nx = a.shape[-2:]
    fy, fx = frequencies(ny, nx)
    wide = ny / (2 * np.pi * sigma)
    return np.fft.irfft2(np.fft.rfft2(a) * np.exp(-(fy * fy + fx * fx) / (2 * wide * wide)), (ny, nx))


def high_pass(a: np.ndarray, sigma: float = 2.5, wiener: float = 0.2, cut: int = 3) -> np.ndarray:
    """The spectrum over a Gaussian (plus a constant), without its mean and its lowest `cut` frequencies along either axis."""
    ny, nx = a.shape[-2:]
    fy, fx = frequencies(ny, nx)
    spectrum = np.fft.rfft2(a) / (np.exp(-(fy * fy + fx * fx) / (2 * sigma * sigma)) + wiener)
    spectrum[..., 0, 0] = 0
    spectrum[..., :cut, :] = 0
    spectrum[..., :cut] = 0
    return np.fft.irfft2(spectrum, (ny, nx))


def band_stop(a: np.ndarray, rows: int = 4) -> np.ndarray:
    """Without the frequencies below `rows` along y, except those that are constant along x."""
    spectrum = np.fft.rfft2(a)
    spectrum[..., :rows, 1:] = 0
    spectrum[..., -rows:, 1:] = 0
    return np.fft.irfft2(spectrum, a.shape[-2:])


def convolved(a: np.ndarray, kernel: np.ndarray, correlate: bool = False) -> np.ndarray:
    """Circular convolution with a kernel of the planes' size, or correlation."""
    k = np.fft.rfft2(kernel)
    return np.fft.irfft2(np.fft.rfft2(a) * (np.conj(k) if correlate else k), a.shape[-2:])


def mexican_hat(a: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Convolved with a mexican hat of a given scale, over the number of pixels."""
    ny, nx = a.shape[-2:]
    y, x = (np.fft.fftfreq(n, 1 / n) for n in (ny, nx))
    r2 = (y[:, None] ** 2 + x[None, :] ** 2) / scale**2
    return convolved(a, 2 / np.sqrt(3) * np.pi**-0.25 * (2 - r2) * np.exp(-r2 / 2)) / (ny * nx)


def shifted(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Circular shift, between pixels too."""
    ny, nx = a.shape[-2:]
    fy, fx = np.fft.fftfreq(ny)[:, None], np.fft.fftfreq(nx)[None, :]
    return np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (fy * dy + fx * dx))).real


def zoomed(a: np.ndarray, ny: int, nx: int) -> np.ndarray:
    """Planes of another size by padding or cutting the spectrum; means stay."""
    spectrum = np.fft.fftshift(np.fft.fft2(a), axes=(-2, -1))
    out = np.zeros((*a.shape[:-2], ny, nx), complex)
    old, new = [], []
    for n, m in zip(a.shape[-2:], (ny, nx)):
        k = min(n, m)
        old.append(slice(n // 2 - k // 2, n // 2 - k // 2 + k))
        new.append(slice(m // 2 - k // 2, m // 2 - k // 2 + k))
    out[..., new[0], new[1]] = spectrum[..., old[0], old[1]]
    return np.fft.ifft2(np.fft.ifftshift(out, axes=(-2, -1))).real * (ny * nx / (a.shape[-2] * a.shape[-1]))


def sobel(a: np.ndarray) -> np.ndarray:
    """Slope along x, smoothed along y; edges mirrored."""
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1), (1, 1)], "symmetric")
    slope = p[..., :, 2:] - p[..., :, :-2]
    return slope[..., :-2, :] + 2 * slope[..., 1:-1, :] + slope[..., 2:, :]


def polar(a: np.ndarray, radii: int, angles: int) -> np.ndarray:
    """Planes over (radius, angle) about their middle, between pixels; radii in whole pixels, angles from 0 to a full turn; 0 outside."""
    ny, nx = a.shape[-2:]
    t = np.arange(angles) * (2 * np.pi / angles)
    y = (ny - 1) / 2 + np.outer(np.arange(radii), np.sin(t))
    x = (nx - 1) / 2 + np.outer(np.arange(radii), np.cos(t))
    return np.stack([sampled(plane, y, x) for plane in a])


def size_and_phase(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the full spectrum, lowest frequencies in the middle."""
    spectrum = np.fft.fftshift(np.fft.fft2(a), axes=(-2, -1))
    return np.abs(spectrum), np.angle(spectrum)


def filtered(planes: DataFrame, kernel: Callable[..., np.ndarray], *args, **named) -> DataFrame:
    """Every plane (z, w, ny, nx, data) through one of the functions above."""
    ship(planes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches):
            own, made = images(batch), [None] * batch.num_rows
            for shape in {a.shape for a in own}:
                at = [i for i, a in enumerate(own) if a.shape == shape]
                for i, a in zip(at, kernel(np.stack([own[i] for i in at]), *args, **named)):
                    made[i] = a
            sizes = [pa.array([a.shape[d] for a in made], pa.int32()) for d in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("z"), batch.column("w"), *sizes, pa.array([a.ravel() for a in made], pa.list_(pa.float64()))], ["z", "w", "ny", "nx", "data"])

    return planes.selectExpr("cast(z as bigint) AS z", "cast(w as bigint) AS w", "ny", "nx", "data").mapInArrow(run, "z long, w long, ny int, nx int, data array<double>")
