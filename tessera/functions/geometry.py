"""Column helpers for points and vectors given as lists of three columns (or names)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column | str]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minus(a: Vector, b: Vector) -> list[Column]:
    return [col(x) - col(y) for x, y in zip(a, b, strict=True)]


def plus(a: Vector, b: Vector) -> list[Column]:
    return [col(x) + col(y) for x, y in zip(a, b, strict=True)]


def times(a: Vector, k: Column | float) -> list[Column]:
    return [col(x) * k for x in a]


def dot(a: Vector, b: Vector) -> Column:
    return sum((col(x) * col(y) for x, y in list(zip(a, b, strict=True))[1:]), col(a[0]) * col(b[0]))


def cross(a: Vector, b: Vector) -> list[Column]:
    (a0, a1, a2), (b0, b1, b2) = (list(map(col, v)) for v in (a, b))
    return [a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Vector, b: Vector) -> Column:
    d = minus(a, b)
    return dot(d, d)


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(distance2(a, b))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> tuple[Column, Column]:
    """Cosine and sine of the torsion about b-c, right-handed; null where a plane is not defined."""
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    n1, n2 = cross(u, v), cross(v, w)
    size = F.nullif(norm(n1) * norm(n2), F.lit(0.0))
    return dot(n1, n2) / size, dot(cross(n1, n2), v) / F.nullif(norm(v), F.lit(0.0)) / size


def tetrahedron_sphere(a: Vector, b: Vector, c: Vector, d: Vector) -> tuple[list[Column], Column]:
    """Centre and radius of the sphere through four points; null where they lie in a plane."""
    u, v, w = minus(b, a), minus(c, a), minus(d, a)
    volume = F.nullif(2 * dot(u, cross(v, w)), F.lit(0.0))
    s = plus(plus(times(cross(v, w), dot(u, u)), times(cross(w, u), dot(v, v))), times(cross(u, v), dot(w, w)))
    off = [x / volume for x in s]
    return plus(a, off), norm(off)


def rotated(p: Vector, axis: Vector, angle: Column | float) -> list[Column]:
    """Rotation of p about a unit axis through the origin."""
    k = cross(axis, p)
    c, s = F.cos(F.lit(angle) if isinstance(angle, float) else angle), F.sin(F.lit(angle) if isinstance(angle, float) else angle)
    along = dot(axis, p)
    return [col(x) * c + y * s + col(z) * along * (1 - c) for x, y, z in zip(p, k, axis, strict=True)]


def undirected_angle(a: Vector, b: Vector) -> Column:
    """Degrees between two lines; 90 where a vector is zero."""
    c = F.abs(dot(a, b)) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.coalesce(F.degrees(F.acos(F.least(F.lit(1.0), c))), F.lit(90.0))
