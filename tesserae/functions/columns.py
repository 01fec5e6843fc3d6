"""Numeric, vector, matrix and plane-geometry functions on columns.

Everything here builds Spark expressions, so it stays inside generated code. A point is a pair
of Columns, or a struct<x, y> where it stands in an array; a polygon is an array of such structs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PARALLEL = 1e-8
_TAU = 2 * math.pi

# Scalars.


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def saturating_sub(a: Column, b: Column) -> Column:
    """a - b, and 0 where b is larger."""
    return F.greatest(F.lit(0.0), a - b)


def mod2pi_pos(v: Column) -> Column:
    """In [0, 2 pi)."""
    return v - F.lit(_TAU) * F.floor(v / _TAU)


def mod2pi(v: Column) -> Column:
    """In [-pi, pi)."""
    return mod2pi_pos(v + math.pi) - math.pi


def poly(coefficients: list, x: Column) -> Column:
    """A polynomial's value; coefficients rise."""
    out = F.lit(0.0)
    for k in reversed(coefficients):
        out = out * x + k
    return out


def poly_derivative(coefficients: list) -> list:
    return [k * i for i, k in enumerate(coefficients)][1:] or [F.lit(0.0)]


# Vectors of any length, as lists of Columns.


def dot(a: list, b: list) -> Column:
    return sum((p * q for p, q in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: list, b: list) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def norm(a: list) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: list) -> list[Column]:
    n = norm(a)
    return [v / n for v in a]


def vec_dist(a: list, b: list) -> Column:
    return norm([p - q for p, q in zip(a, b, strict=True)])


class Matrix:
    """A matrix of Columns (or numbers) whose shape is known when the plan is built."""

    def __init__(self, rows: list[list]):
        self.rows = [[v if isinstance(v, Column) else F.lit(float(v)) for v in r] for r in rows]
        if len({len(r) for r in rows}) != 1:
            raise ValueError("rows differ in length")

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.rows[0])

    @property
    def T(self) -> Matrix:
        return Matrix([list(r) for r in zip(*self.rows, strict=True)])

    def _each(self, f, *others: Matrix) -> Matrix:
        if any(o.shape != self.shape for o in others):
            raise ValueError("shapes differ")
        return Matrix([[f(*v) for v in zip(*r, strict=True)] for r in zip(self.rows, *(o.rows for o in others), strict=True)])

    def __add__(self, other: Matrix) -> Matrix:
        return self._each(lambda a, b: a + b, other)

    def __sub__(self, other: Matrix) -> Matrix:
        return self._each(lambda a, b: a - b, other)

    def scaled(self, k) -> Matrix:
        return self._each(lambda a: a * k)

    def __matmul__(self, other: Matrix) -> Matrix:
        if self.shape[1] != other.shape[0]:
            raise ValueError("shapes don't fit")
        return Matrix([[dot(r, list(q)) for q in zip(*other.rows, strict=True)] for r in self.rows])

    def minor(self, i: int, j: int) -> Matrix:
        return Matrix([[v for q, v in enumerate(r) if q != j] for p, r in enumerate(self.rows) if p != i])

    def det(self) -> Column:
        """By the first row; for small matrices."""
        if self.shape[0] == 1:
            return self.rows[0][0]
        parts = [v * self.minor(0, j).det() * (-1.0 if j % 2 else 1.0) for j, v in enumerate(self.rows[0])]
        return sum(parts[1:], parts[0])

    def inverse(self) -> Matrix:
        """Adjugate by determinant; null where that is 0."""
        n, d = self.shape[0], self.det()
        safe = F.when(d != 0, d)
        if n == 1:
            return Matrix([[F.lit(1.0) / safe]])
        return Matrix([[self.minor(j, i).det() * (-1.0 if (i + j) % 2 else 1.0) / safe for j in range(n)] for i in range(n)])

    def solve(self, b: list) -> list[Column]:
        """x with self @ x = b, by Cramer's rule; null where the matrix is singular."""
        d = self.det()
        safe = F.when(d != 0, d)
        return [Matrix([[b[i] if q == j else v for q, v in enumerate(r)] for i, r in enumerate(self.rows)]).det() / safe for j in range(self.shape[0])]

    def largest(self) -> Column:
        return F.greatest(*(v for r in self.rows for v in r))

    def err_inf(self, other: Matrix) -> Column:
        """Largest difference of entries."""
        return self._each(lambda a, b: F.abs(a - b), other).largest()


# Points, lines and polygons.


def distance(p: tuple, q: tuple) -> Column:
    return F.hypot(q[0] - p[0], q[1] - p[1])


def angle(p: tuple, q: tuple) -> Column:
    return F.atan2(q[1] - p[1], q[0] - p[0])


def _meeting(p0, p1, q0, q1) -> tuple[Column, Column]:
    """Places of the meeting point along either line (0 and 1 at the given points); null where the lines are parallel or a point."""
    dx, dy, ex, ey = p1[0] - p0[0], p1[1] - p0[1], q1[0] - q0[0], q1[1] - q0[1]
    det = dx * ey - dy * ex
    length = F.hypot(dx, dy) * F.hypot(ex, ey)
    safe = F.when((length > 0) & (F.abs(det) >= length * PARALLEL), det)
    rx, ry = q0[0] - p0[0], q0[1] - p0[1]
    return (rx * ey - ry * ex) / safe, (rx * dy - ry * dx) / safe


def line_intersection(p0, p1, q0, q1) -> tuple[Column, Column]:
    """Where two lines meet; nulls where they are parallel."""
    t, _ = _meeting(p0, p1, q0, q1)
    return p0[0] + t * (p1[0] - p0[0]), p0[1] + t * (p1[1] - p0[1])


def segment_intersection(p0, p1, q0, q1) -> tuple[Column, Column]:
    t, s = _meeting(p0, p1, q0, q1)
    t = F.when((t >= 0) & (t <= 1) & (s >= 0) & (s <= 1), t)
    return p0[0] + t * (p1[0] - p0[0]), p0[1] + t * (p1[1] - p0[1])


def polygon(points: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in points])


def _edges(poly_: Column) -> Column:
    after = F.concat(F.slice(poly_, 2, F.greatest(F.size(poly_) - 1, F.lit(0))), F.slice(poly_, 1, 1))
    return F.zip_with(poly_, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def polygon_area(poly_: Column) -> Column:
    """Signed area: positive where the order is counter-clockwise with y up."""
    return F.aggregate(_edges(poly_), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["a"]["y"] * e["b"]["x"]) / 2


def contains_point(poly_: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0) + a["x"])

    return F.size(F.filter(_edges(poly_), crosses)) % 2 == 1


def rescale_corner(v: Column, decimation: float) -> Column:
    """A coordinate of a decimated image in the full one."""
    return v * 1.5 if decimation == 1.5 else v if not decimation else (v - 0.5) * decimation + 0.5
