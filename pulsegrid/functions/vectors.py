"""Column functions over vectors and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def rotation_angle(pitch: Column, yaw: Column, roll: Column, order: str = "XYZ") -> Column:
    """Degrees of the whole rotation, by the trace of the matrix; pitch turns about x, yaw about y, roll about z.

    The traces of the six orders differ only in the sign of the product of the
    sines: it is negative for XYZ, YZX and ZXY, positive for the others.
    """
    if sorted(order) != ["X", "Y", "Z"]:
        raise ValueError("the order must name X, Y and Z once")
    p, y, r = F.radians(pitch), F.radians(yaw), F.radians(roll)
    sines = F.sin(p) * F.sin(y) * F.sin(r) * (-1 if order in ("XYZ", "YZX", "ZXY") else 1)
    trace = F.cos(y) * F.cos(r) + F.cos(p) * F.cos(r) + sines + F.cos(p) * F.cos(y)
    return F.when(trace.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))))


def distance2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def eye_aspect_ratio(p: list[tuple[Column, Column]]) -> Column:
    """(|p2 p6| + |p3 p5|) / (2 |p1 p4|) of six points."""
    d = lambda i, j: distance2(*p[i - 1], *p[j - 1])
    return (d(2, 6) + d(3, 5)) / F.nullif(2 * d(1, 4), F.lit(0.0))


def mouth_openness(mouth: Column, upper: Column, lower: Column) -> Column:
    """Mouth height over the smaller lip height; null if either lip is missing."""
    return F.when(upper.isNotNull() & lower.isNotNull(), mouth / F.nullif(F.least(upper, lower), F.lit(0.0)))


def normalised_face(points: Column, nose: int = 0, left: int = 143, right: int = 372, align: bool = False) -> Column:
    """Points centred on the nose, optionally turned so that the eyes are level, in units of the eye distance."""
    at = lambda i: F.get(points, F.lit(i))
    dx, dy, dz = (at(right)[k] - at(left)[k] for k in "xyz")
    size = F.nullif(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(0.0))
    turn = -F.atan2(dy, dx) if align else F.lit(0.0)
    c, s = F.cos(turn), F.sin(turn)

    def moved(p):
        x, y, z = (p[k] - at(nose)[k] for k in "xyz")
        return F.struct(((x * c - y * s) / size).alias("x"), ((x * s + y * c) / size).alias("y"), (z / size).alias("z"))

    return F.transform(points, moved)


def padded_box(x: Column, y: Column, w: Column, h: Column, share: float) -> Column:
    """A box with a margin of a share of its size on each side, cut off at zero."""
    mw, mh = F.floor(w * share), F.floor(h * share)
    return F.struct(F.greatest(F.lit(0), x - mw).alias("x"), F.greatest(F.lit(0), y - mh).alias("y"), (w + 2 * mw).alias("w"), (h + 2 * mh).alias("h"))


def loudness_gain(level: Column, peak: Column, target: float) -> Column:
    """Gain to a target level that does not clip."""
    return F.least(F.lit(target) - level, -peak)
