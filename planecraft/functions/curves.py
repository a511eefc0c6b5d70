"""Model curves and radial profiles as expressions of a Column: r a distance, t a place along an axis."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma(x: float) -> float:
    """The gamma function of whole and half numbers."""
    if x <= 0 or 2 * x != int(2 * x):
        raise ValueError("gamma is defined for 0.5, 1, 1.5 ... only")
    return math.gamma(x)


def gaussian(r: Column, dim: int = 1, sigma: float = 1.0, integral: float | None = None, peak: float | None = None) -> Column:
    """A Gaussian about 0 with a given integral (1 if nothing is given), or peak."""
    scale = peak if integral is None and peak is not None else (1.0 if integral is None else integral) / (math.sqrt(2 * math.pi) * sigma) ** dim
    return scale * F.exp(-r * r / (2.0 * sigma * sigma))


def lorentzian(r: Column, dim: int = 1, sigma: float = 1.0, integral: float | None = None, peak: float | None = None) -> Column:
    power = (dim + 1) / 2
    unit = gamma(power) / (math.pi**power * abs(sigma))
    scale = integral if integral is not None else peak / unit if peak is not None else 1.0
    return scale * unit * F.pow(1 + r * r / abs(sigma), F.lit(-power))


def mexican_hat(r: Column, dim: int = 1) -> Column:
    return 2 / math.sqrt(3) * math.pi**-0.25 * (dim - r * r) * F.exp(-r * r / 2)


def laplacian_of_gaussian(r: Column, dim: int = 1, sigma: float | None = None, zero: float | None = None, peak: float | None = None) -> Column:
    """The negative Laplacian of a Gaussian; one of sigma and the radius at which it is zero."""
    if (sigma is None) == (zero is None):
        raise ValueError("give sigma or the radius of the zero")
    sigma = sigma if zero is None else zero / math.sqrt(dim)
    depth = dim * sigma**dim
    scale = peak / depth if peak is not None else 1 / (sigma * sigma * (2 * math.pi * sigma) ** (dim / 2))
    return scale * (depth - r * r) * F.exp(-r * r / (2 * sigma * sigma))


def cone(r: Column, scale: float = 1.0) -> Column:
    return F.greatest(1 - F.abs(r), F.lit(0.0)) * scale


def cone_scale(radius: float, dim: int, integral: float = 1.0) -> float:
    return integral / (radius if dim == 1 else math.pi * radius**dim / 3)


def disc(r: Column, radius: float, inside: float = 1.0, outside: float = 0.0) -> Column:
    return F.when(r <= radius, inside).otherwise(outside)


def ring(r: Column, inner: float, outer: float) -> Column:
    return F.when((r > inner) & (r <= outer), 1.0).otherwise(0.0)


def sinc(r: Column, radius: float) -> Column:
    x = r * (math.pi / 2 / radius)
    return F.when(r == 0, 1.0).otherwise(F.sin(x) / F.when(r == 0, 1.0).otherwise(x))


def cosine_squared(r: Column, radius: float, crop: bool = False) -> Column:
    value = F.pow(F.cos(r * (math.pi / 2 / radius)), F.lit(2.0))
    return F.when(r > radius, 0.0).otherwise(value) if crop else value


def sigmoid(x: Column, centre: float = 0.0, width: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-(x - centre) / width))


def line(t: Column, a: float, b: float) -> Column:
    return b + a * t


def polynomial(t: Column, terms: list[float]) -> Column:
    """terms: of power 0, 1, 2 ..."""
    value = F.lit(0.0)
    for c in reversed(terms):
        value = value * t + c
    return value


def paired_polynomial(t: Column, terms: list[float]) -> Column:
    """Sum over the pairs (a, b) of (a t + b) t**i, where i is the pair's place among the terms."""
    return sum(((terms[i] * t + terms[i + 1]) * F.pow(t, F.lit(float(i))) for i in range(0, len(terms), 2)), F.lit(0.0))


def decay(t: Column, base: float, terms: list[tuple[float, float]]) -> Column:
    """base plus exponential decays (height at 0, half time)."""
    return sum((a * F.exp(-t * (math.log(2) / h)) for a, h in terms), F.lit(float(base)))


def exponential_decay(t: Column, rate: float, first: float = 100.0, start: Column | float = 0.0) -> Column:
    return first * F.exp(-rate * (t - start))


def exponential_density(t: Column, rate: float = 1.0) -> Column:
    return rate * F.exp(-rate * t)


def cosine(degrees: Column, height: float, frequency: float, phase: float, mean: float) -> Column:
    return height * F.cos(frequency * (F.radians(degrees) - math.radians(phase))) + mean


def peak_1d(t: Column, base: float, height: float, centre: float, sigma: float, skew: tuple[float, float] | None = None) -> Column:
    """A Gaussian over a base; with skew (a, b) the variance is sigma**2 (a t + b) / 2."""
    width = sigma * sigma * (2 if skew is None else skew[0] * t + skew[1])
    return base + height * F.exp(-(centre - t) * (centre - t) / width)


def peak_2d(y: Column, x: Column, base: float, height: float, centre: tuple[float, float], sigma: tuple[float, float]) -> Column:
    return peak_nd([y, x], base, height, centre, sigma)


def peak_nd(places: list[Column], base: float, height: float, centre, sigma) -> Column:
    apart = sum(((c - p) * (c - p) / (2 * s * s) for p, c, s in zip(places, centre, sigma)), F.lit(0.0))
    return base + height * F.exp(-apart)


def skewed_peak(t: Column, base: float, height: float, centre: float, sigma: float, power: float) -> Column:
    """A Gaussian about centre - 0.5 (a pixel's middle), whose variance grows with t**power."""
    return base + height * F.exp(-F.pow(centre - 0.5 - t, F.lit(2.0)) / (2 * sigma * sigma * F.pow(t, F.lit(power))))
