"""Least squares of model curves and peaks, in numpy, for use inside tasks; and peak lists of planes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planecraft.plans.shipping import ship

PEAKS = "z long, w long, nth int, height double, y double, x double, sigma_y double, sigma_x double, fitted boolean"
#: Bytes of a batch's planes that are worked on at once.
PORTION = 2 << 20


def least_squares(model: Callable[[np.ndarray], np.ndarray], start, values: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, bool]:
    """Parameters that bring model(p) nearest to values (damped Gauss-Newton steps, differences for derivatives), and whether the steps came to rest."""
    p, damp = np.array(start, float), 1e-3
    rest = values - model(p)
    cost = rest @ rest
    for _ in range(rounds):
        steps = 1e-6 * np.maximum(np.abs(p), 1e-3)
        slope = np.stack([(model(p + step * unit) - model(p)) / step for step, unit in zip(steps, np.eye(len(p)))], 1)
        square, down = slope.T @ slope, slope.T @ rest
        while damp < 1e12:
            try:
                move = np.linalg.solve(square + damp * np.diag(np.maximum(np.diag(square), 1e-12)), down)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            new = values - model(p + move)
            if np.isfinite(new).all() and new @ new < cost:
                break
            damp *= 10
        else:
            return p, True  # no step leads down
        gain, p, rest, damp = cost - new @ new, p + move, new, max(damp / 10, 1e-9)
        cost = rest @ rest
        if gain <= 1e-12 * (cost + 1e-300) or np.abs(move).max() < 1e-9 * (1 + np.abs(p).max()):
            return p, True
    return p, False


def gaussian(p: np.ndarray, places: np.ndarray) -> np.ndarray:
    """p: base, height, centre (ndim), sigma (ndim); places (n, ndim)."""
    n = places.shape[1]
    return p[0] + p[1] * np.exp(-(((places - p[2 : 2 + n]) / p[2 + n :]) ** 2).sum(1) / 2)


def window(shape: tuple[int, ...], place, width: int) -> tuple[slice, ...]:
    """About `width` pixels round a place along each axis, inside the array."""
    return tuple(slice(max(0, int(c + 0.5 - width / 2)), min(n, max(int(c + 0.5 + width / 2), int(c + 0.5 - width / 2) + 1))) for n, c in zip(shape, place))


def fit_peak(image: np.ndarray, place, sigma=2.0, width: int = 11) -> tuple[np.ndarray, bool]:
    """(base, height, centre, sigma) of a Gaussian in a window round a place, in pixels of the image (0 is a pixel's middle), and whether it is sound."""
    cut = window(image.shape, place, width)
    part = image[cut].astype(float)
    places = np.stack(np.meshgrid(*[np.arange(s.start, s.stop) for s in cut], indexing="ij"), -1).reshape(-1, image.ndim).astype(float)
    n, sigmas = image.ndim, np.broadcast_to(np.array(sigma, float), image.ndim)
    start = np.concatenate(([part.min(), part.max() - part.min()], np.array(place, float), sigmas))
    if part.size < len(start) or start[1] <= 0:
        return start, False
    p, good = least_squares(lambda q: gaussian(q, places), start, part.ravel())
    p[2 + n :] = np.abs(p[2 + n :])
    return p, bool(good and (np.abs(p[2 : 2 + n] - place) <= width).all() and p[1] > 0)


def brightest(image: np.ndarray, sigma=2.0, width: int = 11) -> tuple[float, np.ndarray, np.ndarray, bool]:
    """Height, place and sigma of the greatest value's peak; the pixel itself where the fit fails."""
    place = np.array(np.unravel_index(int(image.argmax()), image.shape), float)
    p, good = fit_peak(image, place, sigma, width)
    n = image.ndim
    if not good:
        return float(image.max()), place, np.broadcast_to(np.array(sigma, float), n).copy(), False
    return float(p[1]), p[2 : 2 + n], p[2 + n :], True


def without_peak(image: np.ndarray, height: float, place, sigma) -> np.ndarray:
    """The image less a Gaussian, nowhere below 0 by that."""
    places = np.stack(np.meshgrid(*map(np.arange, image.shape), indexing="ij"), -1).reshape(-1, image.ndim).astype(float)
    bump = gaussian(np.concatenate(([0.0, height], place, sigma)), places).reshape(image.shape)
    return image - np.where(bump > image, image, bump)


def all_peaks(image: np.ndarray, most: int, least: float, sigma=2.0, width: int = 11) -> list[tuple]:
    """(height, place, sigma, fitted) of the brightest peaks in turn, down to a height; each is taken off before the next is sought."""
    left, found = image.astype(float).copy(), []
    for _ in range(most):
        if left.max() < least:
            break
        height, place, wide, good = brightest(left, sigma, width)
        found.append((height, place, wide, good))
        top = np.unravel_index(int(left.argmax()), left.shape)
        left = without_peak(left, height, place, wide) if good else left
        left[top] = min(left[top], least - 1e-9)
    return found


def images(batch: pa.RecordBatch, column: str = "data") -> list[np.ndarray]:
    """A batch's planes, as views of its values."""
    lists = batch.column(column)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    shapes = zip(batch.column("ny").to_pylist(), batch.column("nx").to_pylist())
    return [values[e - ny * nx : e].reshape(ny, nx) for e, (ny, nx) in zip(ends.tolist(), shapes)]


def in_portions(batches: Iterator[pa.RecordBatch], each: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches as views of some rows at a time, so that what is made of their planes doesn't stand in memory for a whole batch at once."""
    for batch in batches:
        rows = max(1, each * batch.num_rows // max(1, batch.nbytes))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def peaks(planes: DataFrame, most: int, least: float, sigma: float = 2.0, width: int = 11) -> DataFrame:
    """The peak list of every plane (z, w, ny, nx, data)."""
    ship(planes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for z, w, image in zip(batch.column("z").to_pylist(), batch.column("w").to_pylist(), images(batch)):
                rows += [(z, w, i, h, *map(float, c), *map(float, s), good) for i, (h, c, s, good) in enumerate(all_peaks(image, most, least, sigma, width))]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32()] + [pa.float64()] * 5 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [c.split()[0] for c in PEAKS.split(", ")])

    return planes.selectExpr("z", "cast(w as bigint) AS w", "ny", "nx", "data").mapInArrow(run, PEAKS)


def fit_decay(t: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bool]:
    """(base, height, half time) of an exponential decay."""
    span = max(float(np.ptp(t)), 1e-9)
    return least_squares(lambda p: p[0] + p[1] * np.exp2(-(t - t[0]) / max(abs(p[2]), 1e-9)), [values[-1], values[0] - values[-1], span / 3], values)


def fit_rate(t: np.ndarray, values: np.ndarray) -> tuple[float, float, float, bool]:
    """Rate, mean life and half life of a decay from the first value."""
    p, good = least_squares(lambda q: values[0] * np.exp(-q[0] * (t - t[0])), [1 / max(float(np.ptp(t)), 1e-9)], values)
    life = 1 / p[0] + t[0] if p[0] else np.inf
    return float(p[0]), float(life), float(np.log(2) * life), good


def fit_polynomial(t: np.ndarray, values: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients of power 0, 1 ..."""
    return np.linalg.lstsq(np.vander(t.astype(float), degree + 1, increasing=True), values.astype(float), rcond=None)[0]


def simplex(cost: Callable[[np.ndarray], float], start, size, rounds: int = 300, rest: float = 1e-6) -> np.ndarray:
    """A minimum by the downhill simplex method."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + np.eye(n)[i] * size[i] for i in range(n)]
    found = [cost(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(found, kind="stable")
        points, found = [points[i] for i in order], [found[i] for i in order]
        if found[-1] - found[0] < rest * (abs(found[0]) + rest):
            break
        middle = np.mean(points[:-1], 0)
        over = middle + (middle - points[-1])
        value = cost(over)
        if value < found[0]:
            far = middle + 2 * (middle - points[-1])
            other = cost(far)
            points[-1], found[-1] = (far, other) if other < value else (over, value)
        elif value < found[-2]:
            points[-1], found[-1] = over, value
        else:
            near = middle + 0.5 * ((over if value < found[-1] else points[-1]) - middle)
            other = cost(near)
            if other < min(value, found[-1]):
                points[-1], found[-1] = near, other
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                found = [found[0]] + [cost(p) for p in points[1:]]
    return points[int(np.argmin(found))]
