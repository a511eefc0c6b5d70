"""Alignment of planes: correlation with a sub-pixel peak, shift, rotation and zoom from four quadrants, and its application.

Spark pairs the planes and deals the pairs; a task holds the planes of one Arrow batch, and makes some megabytes of new ones at a time. Parameters (ty, tx, r, my, mx)
describe the map that `kernels.affine` applies: rotation (degrees) and zoom about the middle, then a shift.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.operators.fitting import brightest, images, in_portions, simplex, window
from planecraft.operators.kernels import affine
from planecraft.plans.shipping import ship
from planecraft.plans.storage import checked

FOUND = "z long, w long, ty double, tx double, r double, my double, mx double, quality double, converged boolean"
NONE = np.array([0.0, 0.0, 0.0, 1.0, 1.0])


def even(image: np.ndarray) -> np.ndarray:
    return image[: image.shape[0] // 2 * 2, : image.shape[1] // 2 * 2]


def softened(image: np.ndarray, width: int = 10) -> np.ndarray:
    """Edges led to the median in equal steps."""
    depth = np.minimum.outer(*[np.minimum(np.arange(n), np.arange(n)[::-1]) for n in image.shape])
    share = np.minimum(depth, width) / width
    return image * share + np.median(image) * (1 - share)


def low_pass(shape: tuple[int, int], sigma: float) -> np.ndarray:
    """A Gaussian over the half spectrum; sigma as a share of the highest frequency."""
    fy, fx = np.fft.fftfreq(shape[0])[:, None] * 2, np.fft.rfftfreq(shape[1])[None, :] * 2
    return np.exp(-(fy * fy + fx * fx) / (2 * sigma * sigma))


def phase_only(spectrum: np.ndarray) -> np.ndarray:
    size = np.abs(spectrum)
    out = np.where(size > 1e-12 * max(size.max(), 1e-300), spectrum / np.maximum(size, 1e-300), 0)
    out[0, 0] = 0
    return out


def correlation(a: np.ndarray, b: np.ndarray, phase: bool = True, sigma: float = 0.3, width: int = 10) -> np.ndarray:
    """Correlation image of b with a; its middle stands for no shift. By phases alone, or of the values over their deviations."""
    a, b = (softened(even(x.astype(float)), width) if width else even(x.astype(float)) for x in (a, b))
    if not phase:
        scale = a.std() * b.std() * a.size or 1.0
        fa, fb = np.fft.rfft2(a - a.mean()), np.fft.rfft2(b - b.mean()) / scale
    else:
        keep = low_pass(a.shape, sigma)
        fa, fb = phase_only(np.fft.rfft2(a)) * keep, phase_only(np.fft.rfft2(b)) * keep
    return np.fft.fftshift(np.fft.irfft2(fb * np.conj(fa), a.shape))


def shift_between(a: np.ndarray, b: np.ndarray, phase: bool = True, reach: float | None = None, width: int = 10) -> tuple[np.ndarray, float]:
    """(dy, dx) by which b's content stands off a's, and the peak's height over the image's deviation."""
    image = correlation(a, b, phase, width=min(width, max(1, min(a.shape) // 4)))
    middle = np.array(image.shape) // 2
    sought = image
    if reach is not None:
        cut = window(image.shape, middle, int(2 * reach + 1))
        sought = np.full_like(image, image.min())
        sought[cut] = image[cut]
    _, place, _, _ = brightest(sought, 1.0, 7)
    return place - middle, float(image.max() - image[:, : max(1, image.shape[1] // 4)].std())


def quadrants(image: np.ndarray, centre: tuple[int, int]) -> list[np.ndarray]:
    """Upper right, upper left, lower left, lower right, where y points up."""
    cy, cx = centre
    return [image[cy:, cx:], image[cy:, :cx], image[:cy, :cx], image[:cy, cx:]]


def from_shifts(shifts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Least squares of (ty, tx, r, my, mx) from shifts (n, 2) at places (n, 2) about the middle, for small angles and zooms."""
    y, x = places.T
    one, none = np.ones(len(y)), np.zeros(len(y))
    rows = np.concatenate((np.stack((one, none, -x, y, none), 1), np.stack((none, one, y, none, x), 1)))
    ty, tx, theta, my, mx = np.linalg.lstsq(rows, np.concatenate((shifts[:, 0], shifts[:, 1])), rcond=None)[0]
    return np.array([ty, tx, np.degrees(theta), 1 + my, 1 + mx])


def composed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Shifts and angles add, zooms multiply."""
    return np.concatenate((p[:3] + q[:3], p[3:] * q[3:]))


def error_in_pixels(p: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Each parameter as a way of the point half way from the middle to a corner."""
    radius = np.hypot(*shape) / 4
    return np.abs(np.array([p[0], p[1], 2 * np.sin(np.radians(abs(p[2])) / 2) * radius, (p[3] - 1) * radius, (p[4] - 1) * radius]))


def estimate(moved: np.ndarray, reference: np.ndarray, reach: float) -> tuple[np.ndarray, float]:
    """What is left between two nearly aligned planes, by the shifts of their quadrants; and the least quality of the four."""
    centre = tuple(n // 2 for n in moved.shape)
    shifts, quality = [], []
    for a, b in zip(quadrants(moved, centre), quadrants(reference, centre)):
        s, q = shift_between(a, b, reach=reach)
        shifts.append(s)
        quality.append(q)
    cy, cx = ((n - 1) / 2 for n in moved.shape)
    y0, y1, x0, x1 = centre[0] / 2 - 0.5, (moved.shape[0] + centre[0]) / 2 - 0.5, centre[1] / 2 - 0.5, (moved.shape[1] + centre[1]) / 2 - 0.5
    places = np.array([(y1, x1), (y1, x0), (y0, x0), (y0, x1)]) - (cy, cx)
    return from_shifts(np.array(shifts), places), min(quality)


def log_polar(moved: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Rotation and zoom from the spectra's sizes in log-polar coordinates, then the shift."""
    n = min(moved.shape)

    def polar(image: np.ndarray) -> np.ndarray:
        part = softened(image.astype(float), max(1, n // 8))
        size = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(part - part.mean()))))
        angles, steps = np.linspace(0, np.pi, 180, endpoint=False), np.exp(np.linspace(np.log(2), np.log(n / 2 - 2), 180))
        y = image.shape[0] // 2 + np.outer(np.sin(angles), steps) * image.shape[0] / n
        x = image.shape[1] // 2 + np.outer(np.cos(angles), steps) * image.shape[1] / n
        iy, ix = np.clip(y.astype(int), 0, image.shape[0] - 2), np.clip(x.astype(int), 0, image.shape[1] - 2)
        fy, fx = y - iy, x - ix
        return size[iy, ix] * (1 - fy) * (1 - fx) + size[iy + 1, ix] * fy * (1 - fx) + size[iy, ix + 1] * (1 - fy) * fx + size[iy + 1, ix + 1] * fy * fx

    (turn, grow), _ = shift_between(polar(moved), polar(reference), width=0)
    step = np.log((n / 2 - 2) / 2) / 179
    zoom = float(np.exp(-grow * step))
    p = np.array([0.0, 0.0, -turn, zoom, zoom])
    shift, _ = shift_between(affine(moved, *p), reference)
    p[:2] = shift
    return p


def by_simplex(moved: np.ndarray, reference: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The parameters whose image correlates best with the reference."""
    b = reference - reference.mean()

    def cost(p: np.ndarray) -> float:
        a = affine(moved, *p)
        a = a - a.mean()
        return -float((a * b).sum() / max(1e-12, np.sqrt((a * a).sum() * (b * b).sum())))

    return simplex(cost, start, [1.0, 1.0, 0.5, 0.01, 0.01])


def align(moved: np.ndarray, reference: np.ndarray, max_error: float = 0.01, rounds: int = 10, max_shift: float | None = None, otherwise: str = "simplex", least: float = 0.02) -> tuple[np.ndarray, float, bool]:
    """Parameters that bring `moved` onto `reference`, the last quality, and whether they came to rest within `max_error` pixels.

    Begins with the shift of the whole planes, then adds what the quadrants tell, over the part that both planes cover.
    Where a quadrant's correlation is too low, goes on by `otherwise`: simplex, logpolar or terminate.
    """
    start, _ = shift_between(moved, reference, reach=max_shift)
    p, quality = np.concatenate((start, NONE[2:])), 0.0
    for _ in range(rounds):
        now = affine(moved, *p)
        edge = np.ceil(np.abs(p[:2]) + error_in_pixels(np.concatenate(([0, 0], p[2:])), moved.shape)[2:].max()).astype(int)
        edge = np.minimum(edge, np.array(moved.shape) // 4)
        cut = tuple(slice(e, n - e) for e, n in zip(edge.tolist(), moved.shape))
        left, quality = estimate(now[cut], reference[cut], max(5.0, (max_shift or 0) / 20))
        if quality < least or max_shift is not None and np.hypot(*p[:2]) > max_shift:
            if otherwise == "simplex":
                return by_simplex(moved, reference, p), quality, True
            if otherwise == "logpolar":
                return log_polar(moved, reference), quality, True
            return p, quality, False
        p = composed(p, left)
        if (error_in_pixels(left, moved.shape) < max_error).all():
            return p, quality, True
    return p, quality, False


def aligned(planes: DataFrame, references: DataFrame, **how) -> DataFrame:
    """Parameters of every plane (z, w, ny, nx, data) against the reference of its z (z, ref): the pairs meet by z."""
    ship(planes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for z, w, a, b in zip(batch.column("z").to_pylist(), batch.column("w").to_pylist(), images(batch), images(batch, "ref")):
                p, quality, good = align(a, b, **how)
                rows.append((z, w, *map(float, p), quality, good))
            if rows:
                types = [pa.int64(), pa.int64()] + [pa.float64()] * 6 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [c.split()[0] for c in FOUND.split(", ")])

    pairs = planes.join(references, "z").selectExpr("z", "cast(w as bigint) AS w", "ny", "nx", "data", "ref")
    return pairs.mapInArrow(run, FOUND)


def applied(planes: DataFrame, params: DataFrame) -> DataFrame:
    """Planes through the parameters of their channel (w, ty, tx, r, my, mx), a row for each channel."""
    ship(planes.sparkSession)
    both = planes.join(checked(params.select("w", "ty", "tx", "r", "my", "mx"), "parameters"), "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches):
            p = zip(*(batch.column(c).to_pylist() for c in ("ty", "tx", "r", "my", "mx")))
            made = [affine(a, *q).ravel() for a, q in zip(images(batch), p)]
            kept = batch.select(["z", "w", "ny", "nx"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(made, pa.list_(pa.float64()))], ["z", "w", "ny", "nx", "data"])

    rows = both.selectExpr("z", "cast(w as bigint) AS w", "ny", "nx", "data", "ty", "tx", "r", "my", "mx")
    return rows.mapInArrow(run, "z long, w long, ny int, nx int, data array<double>")


def moved_in_z(planes: DataFrame, shift: float, zoom: float = 1.0) -> DataFrame:
    """The stack shifted and zoomed along z about its middle, between neighbouring planes; 0 beyond its ends. A plane goes to the places that it has a part in."""
    ends = checked(planes.groupBy("w").agg(F.min("z").alias("z0"), F.max("z").alias("z1")), "ends")
    middle = (F.col("z0") + F.col("z1")) / 2
    low = F.greatest(F.col("z0"), F.ceil((F.col("z") - 1 - middle) * zoom + middle + shift))
    high = F.least(F.col("z1"), F.floor((F.col("z") + 1 - middle) * zoom + middle + shift))
    to = planes.join(ends, "w").where(low <= high).withColumn("to", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    share = 1 - F.abs((F.col("to") - middle - shift) / zoom + middle - F.col("z"))
    parts = to.withColumn("share", share).where("share > 0")
    # whole planes meet at a place: two of them, or some more if the stack shrinks
    met = parts.groupBy("w", "to", "ny", "nx").agg(F.array_sort(F.collect_list(F.struct("z", "share", "data"))).alias("s"))
    none = F.transform(F.get("s", F.lit(0))["data"], lambda v: F.lit(0.0))
    sums = F.aggregate("s", none, lambda a, p: F.zip_with(a, p["data"], lambda x, v: x + v * p["share"]))
    return met.select(F.col("to").alias("z"), "w", "ny", "nx", sums.alias("data"))


def drift(frames: DataFrame, reference_frame: int, reference_channel: int, turns: bool = False) -> DataFrame:
    """(image, t, w, ty, tx, r, my, mx) that bring every frame of an image (image, t, w, ny, nx, data) onto its reference frame.

    Found in the reference channel and valid for all channels. Without `turns` a frame only shifts; zooms stay 1.
    An image without the reference frame or channel gives no rows.
    """
    own = frames.where(F.col("w") == reference_channel).select(F.col("image").cast("long").alias("z"), F.col("t").cast("long").alias("w"), "ny", "nx", "data")
    reference = own.where(F.col("w") == reference_frame)
    found = aligned(own.where(F.col("w") != reference_frame), reference.select("z", F.col("data").alias("ref")), **({} if turns else {"rounds": 0}))
    at_rest = reference.select("z", "w", *[F.lit(0.0).alias(c) for c in ("ty", "tx", "r")])
    moved = found.select("z", "w", "ty", "tx", "r").unionAll(at_rest).withColumnsRenamed({"z": "image", "w": "t"})
    channels = frames.select(F.col("image").cast("long").alias("image"), F.col("t").cast("long").alias("t"), F.col("w").cast("long").alias("w"))
    return channels.join(moved, ["image", "t"]).select("image", "t", "w", "ty", "tx", "r", F.lit(1.0).alias("my"), F.lit(1.0).alias("mx"))
