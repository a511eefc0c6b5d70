"""Coordinates (y, x), segments and boxes as expressions. A point is a pair of Columns, a segment a pair of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
Segment = tuple[Point, Point]


def rotate(p: Point, degrees: Column, centre: Point) -> Point:
    """Counter-clockwise about a centre."""
    (y, x), (cy, cx) = p, centre
    sin, cos = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return (y - cy) * cos + (x - cx) * sin + cy, (x - cx) * cos - (y - cy) * sin + cx


def zoom(p: Point, factor: Column, centre: Point) -> Point:
    return tuple((v - c) * factor + c for v, c in zip(p, centre))


def affine(p: Point, degrees: Column, factor: Column, shift: Point, centre: Point) -> Point:
    """Rotation about a centre, a zoom of the second axis, and a shift from the origin."""
    y, x = (v - c for v, c in zip(p, centre))
    sin, cos = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return cos * y - sin * x + shift[0], (sin * y + cos * x) * factor + shift[1]


def affine_index(p: Point, degrees: Column, factors: Point, shift: Point, centre: Point) -> Point:
    """Where a pixel is read from when an image is rotated and zoomed about a centre, then shifted."""
    y, x = (v - c for v, c in zip(p, centre))
    sin, cos = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return (cos * y - sin * x) / factors[0] + shift[0] + centre[0], (sin * y + cos * x) / factors[1] + shift[1] + centre[1]


def flip(p: Point, which: str, centre: Point, shift: Point) -> Point:
    """Mirrored in x, y or both ('X', 'Y', 'XY')."""
    made = [2 * c - v - s for v, c, s in zip(p, centre, shift)]
    return made[0] if "Y" in which else p[0], made[1] if "X" in which else p[1]


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(sum(((v - w) * (v - w) for v, w in zip(a, b)), F.lit(0.0)))


def near(a: Point, b: Point, r: Column | float) -> Column:
    return distance(a, b) < r


def angle(start: Point, end: Point) -> Column:
    """Radians, from the x axis towards y."""
    return F.atan2(end[0] - start[0], end[1] - start[1])


def equal(a: Point, b: Point, eps: float = 0.01) -> Column:
    return (F.abs(a[0] - b[0]) < eps) & (F.abs(a[1] - b[1]) < eps)


def opposite(a: Segment, b: Segment, eps: float = 0.01) -> Column:
    """The same segment in the other direction."""
    return equal(a[0], b[1], eps) & equal(a[1], b[0], eps)


def side(p: Point, s: Segment) -> Column:
    """Below 0 to the right of the segment, above 0 to the left, 0 on its line."""
    (y, x), ((y0, x0), (y1, x1)) = p, s
    return (y - y0) * (x1 - x0) - (x - x0) * (y1 - y0)


def corners(box: Segment) -> tuple[Point, Point]:
    """The lower left and the upper right corner."""
    (y0, x0), (y1, x1) = box
    return (F.least(y0, y1), F.least(x0, x1)), (F.greatest(y0, y1), F.greatest(x0, x1))


def inside(p: Point, box: Segment) -> Column:
    (y0, x0), (y1, x1) = corners(box)
    return p[0].between(y0, y1) & p[1].between(x0, x1)


def box_segments(box: Segment) -> Column:
    """The four sides as an array of structs (y0, x0, y1, x1), round the box."""
    (y0, x0), (y1, x1) = corners(box)
    round_ = [(y0, x0), (y0, x1), (y1, x1), (y1, x0)]
    sides = zip(round_, round_[1:] + round_[:1])
    return F.array(*[F.struct(a[0].alias("y0"), a[1].alias("x0"), b[0].alias("y1"), b[1].alias("x1")) for a, b in sides])


def to_line(p: Point, s: Segment, ends: bool = False) -> Column:
    """Distance from a segment's line, or with `ends` from the segment itself."""
    (y, x), ((y1, x1), (y2, x2)) = p, s
    dy, dx = y2 - y1, x2 - x1
    u = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) if ends else u
    return distance(p, (y1 + u * dy, x1 + u * dx))


def to_segments(p: Point, segments: Column) -> Column:
    """The least distance from an array of structs (y0, x0, y1, x1)."""
    return F.array_min(F.transform(segments, lambda s: to_line(p, ((s["y0"], s["x0"]), (s["y1"], s["x1"])), True)))


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def centre_slice(size: Column, window: Column | float, centre: Column | None = None) -> tuple[Column, Column]:
    """Start and end of a window about the middle of an axis; a window up to 1 is a share of the size."""
    window = F.when(F.lit(window) > 1, F.lit(window)).otherwise(size * F.lit(window))
    middle = (size / 2 if centre is None else centre) + 0.5000001
    return truncated(middle - window / 2), truncated(middle + window / 2)


def nearby(size: Column, place: Column, width: Column | float) -> tuple[Column, Column]:
    """Start and end of about `width` pixels round a place of an axis, inside it; at least one pixel."""
    width = F.rint(F.lit(width))
    start, end = (truncated(place + 0.5000001 + sign * width / 2) for sign in (-1, 1))
    grown = F.when((end == start) & (end < size - 1), end + 1).otherwise(end)
    back = F.when((end == start) & ~(end < size - 1) & (start > 0), start - 1).otherwise(start)
    return F.greatest(back, F.lit(0).cast("long")), F.least(grown, size.cast("long"))


def even(size: Column, less: bool = True) -> Column:
    return F.when(size % 2 == 1, size - 1 if less else size + 1).otherwise(size)


def even_span(low: Column, high: Column, least: int, most: int) -> tuple[Column, Column]:
    """A span made even: the low end moves down, else the high end up, else down."""
    odd = (high - low) % 2 == 1
    down = odd & (low != least)
    up = odd & (low == least) & (high != most)
    return F.when(down, low - 1).otherwise(low), F.when(up, high + 1).when(odd & ~down & ~up & (low <= least) & (high >= most), high - 1).otherwise(high)
