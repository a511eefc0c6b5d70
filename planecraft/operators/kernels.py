"""Numeric kernels that SQL can't express: Fourier correlation and affine resampling, on Arrow batches of planes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planecraft.operators.fitting import images, in_portions
from planecraft.plans.shipping import ship


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, height): the shift of b against a by phase correlation, with a parabola through the peak's neighbours."""
    spectrum = np.fft.rfft2(a) * np.conj(np.fft.rfft2(b))
    image = np.fft.irfft2(spectrum / np.maximum(np.abs(spectrum), 1e-12), a.shape)
    peak = np.unravel_index(int(image.argmax()), image.shape)
    found = []
    for axis, n in enumerate(image.shape):
        line = np.take(image, peak[1 - axis], 1 - axis)
        left, mid, right = line[(peak[axis] - 1) % n], line[peak[axis]], line[(peak[axis] + 1) % n]
        bend = left - 2 * mid + right
        place = peak[axis] + (0.5 * (left - right) / bend if bend < 0 else 0.0)
        found.append(-(place - n if place > n / 2 else place))
    return found[0], found[1], float(image[peak])


@lru_cache(maxsize=2)
def places(ny: int, nx: int, ty: float, tx: float, degrees: float, my: float, mx: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of a mapped plane is read; kept for the next plane."""
    cy, cx, t = (ny - 1) / 2, (nx - 1) / 2, np.deg2rad(degrees)
    y, x = np.mgrid[:ny, :nx].astype(float)
    y, x = (y - cy - ty) / my, (x - cx - tx) / mx
    return np.cos(t) * y + np.sin(t) * x + cy, -np.sin(t) * y + np.cos(t) * x + cx


def affine(plane: np.ndarray, ty: float, tx: float, degrees: float, my: float, mx: float, order: int = 1) -> np.ndarray:
    """Resampling after rotation and zoom about the centre, then a shift; 0 outside. Bilinear, or by cubic splines (order 3)."""
    ny, nx = plane.shape
    y, x = places(ny, nx, float(ty), float(tx), float(degrees), float(my), float(mx))
    if order == 3:
        return cubic(plane, y, x)
    if order != 1:
        raise ValueError("planes are resampled by order 1 or 3")
    iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - iy, x - ix
    padded, out = np.pad(plane, 1), np.zeros_like(plane)
    for a, b, w in ((0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)):
        out += w * padded[np.clip(iy + a + 1, 0, ny + 1), np.clip(ix + b + 1, 0, nx + 1)]
    return out


def spline_coefficients(values: np.ndarray) -> np.ndarray:
    """B-spline coefficients along the first axis, mirrored at both ends: one recursion forwards and one back."""
    n, pole = len(values), np.sqrt(3.0) - 2.0
    if n == 1:
        return values.astype(float)
    c = 6.0 * values.astype(float)
    k = np.arange(n)
    weight = pole**k + np.where((k > 0) & (k < n - 1), pole ** (2 * n - 2 - k), 0.0)
    c[0] = np.tensordot(weight, c, 1) / (1 - pole ** (2 * n - 2))
    for i in range(1, n):
        c[i] += pole * c[i - 1]
    c[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
    for i in range(n - 2, -1, -1):
        c[i] = pole * (c[i + 1] - c[i])
    return c


def cubic(plane: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of the plane's cubic spline at places; 0 outside."""
    ny, nx = plane.shape
    c = spline_coefficients(spline_coefficients(plane).T).T
    mirror = lambda i, n: np.abs((np.abs(i) + n - 1) % (2 * n - 2) - n + 1) if n > 1 else np.zeros_like(i)

    def weights(d: np.ndarray) -> list[np.ndarray]:
        e = 1 - d
        return [e**3 / 6, (4 - 6 * d**2 + 3 * d**3) / 6, (4 - 6 * e**2 + 3 * e**3) / 6, d**3 / 6]

    iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx, out = weights(y - iy), weights(x - ix), np.zeros(y.shape)
    for a in range(4):
        rows = mirror(iy + a - 1, ny)
        out += wy[a] * sum(wx[b] * c[rows, mirror(ix + b - 1, nx)] for b in range(4))
    edge = 1e-9
    return np.where((y >= -edge) & (y <= ny - 1 + edge) & (x >= -edge) & (x <= nx - 1 + edge), out, 0.0)


def correlated(planes: DataFrame, reference: DataFrame) -> DataFrame:
    """Shift of every plane against its channel's reference plane (w, ref): (z, w, dy, dx, height)."""
    ship(planes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([phase_shift(r, p) for r, p in zip(images(batch, "ref"), images(batch))]).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"z": batch.column("z"), "w": batch.column("w"), "dy": found[:, 0], "dx": found[:, 1], "height": found[:, 2]})

    return planes.join(reference, "w").select("z", "w", "ny", "nx", "data", "ref").mapInArrow(run, "z long, w int, dy double, dx double, height double")


def resampled(planes: DataFrame, params: dict[str, float], order: int = 1) -> DataFrame:
    """Every plane through one affine map."""
    ship(planes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches):
            made = [affine(x, **params, order=order).ravel() for x in images(batch)]
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(made, pa.list_(pa.float64())))

    return planes.mapInArrow(run, planes.schema)
