"""Plane geometry: points, lines, polygons. Points are (x, y) pairs; y grows downward."""

from __future__ import annotations

import math

PARALLEL = 1e-8


def distance(p, q) -> float:
    return math.hypot(q[0] - p[0], q[1] - p[1])


def angle(p, q) -> float:
    return math.atan2(q[1] - p[1], q[0] - p[0])


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def line_intersection(p0, p1, q0, q1):
    """Where two lines meet, or None if they are parallel."""
    hit = _parameters(p0, p1, q0, q1)
    return None if hit is None else _at(p0, p1, hit[0])


def segment_line_intersection(p0, p1, q0, q1):
    """Where the segment p meets the line q."""
    hit = _parameters(p0, p1, q0, q1)
    return _at(p0, p1, hit[0]) if hit and 0 <= hit[0] <= 1 else None


def segment_intersection(p0, p1, q0, q1):
    hit = _parameters(p0, p1, q0, q1)
    return _at(p0, p1, hit[0]) if hit and 0 <= hit[0] <= 1 and 0 <= hit[1] <= 1 else None


def _at(p0, p1, t):
    return p0[0] + t * (p1[0] - p0[0]), p0[1] + t * (p1[1] - p0[1])


def _parameters(p0, p1, q0, q1):
    a, b = distance(p0, p1), distance(q0, q1)
    if a == 0 or b == 0:
        return None
    d, e = (p1[0] - p0[0], p1[1] - p0[1]), (q1[0] - q0[0], q1[1] - q0[1])
    det = d[0] * e[1] - d[1] * e[0]
    if abs(det / (a * b)) < PARALLEL:
        return None
    r = (q0[0] - p0[0], q0[1] - p0[1])
    return (r[0] * e[1] - r[1] * e[0]) / det, (r[0] * d[1] - r[1] * d[0]) / det


def closest_on_segment(p0, p1, q):
    n = (p1[0] - p0[0]) ** 2 + (p1[1] - p0[1]) ** 2
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((q[0] - p0[0]) * (p1[0] - p0[0]) + (q[1] - p0[1]) * (p1[1] - p0[1])) / n))
    return _at(p0, p1, t)


def edges(poly):
    return [(poly[i], poly[(i + 1) % len(poly)]) for i in range(len(poly))]


def area(poly) -> float:
    """Signed area: positive where the order is counter-clockwise with y up."""
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in edges(poly)) / 2


def make_ccw(poly):
    return list(poly) if area(poly) >= 0 else list(poly)[::-1]


def convex_hull(points):
    """Corners of the hull, counter-clockwise from the least point."""
    p = sorted(set(map(tuple, points)))
    if len(p) < 3:
        return p

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(reversed(p))


def contains_point(poly, q) -> bool:
    """Even-odd rule."""
    inside = False
    for (x0, y0), (x1, y1) in edges(poly):
        if (y0 > q[1]) != (y1 > q[1]) and q[0] < (x1 - x0) * (q[1] - y0) / (y1 - y0) + x0:
            inside = not inside
    return inside


def intersects(a, b) -> bool:
    """Whether any two edges meet."""
    return any(segment_intersection(*e, *f) is not None for e in edges(a) for f in edges(b))


def contains_polygon(outer, inner) -> bool:
    return not intersects(outer, inner) and contains_point(outer, inner[0])


def interior_point(poly):
    """A point inside a simple polygon, concave ones too: the middle of the widest stretch inside along a line halfway between two heights of corners."""
    heights = sorted({p[1] for p in poly})
    best = None
    for low, high in zip(heights, heights[1:], strict=False):
        y = (low + high) / 2
        xs = rasterize(poly, y)
        for x0, x1 in zip(xs[::2], xs[1::2], strict=True):
            size = min(x1 - x0, high - low)
            if best is None or size > best[0]:
                best = size, ((x0 + x1) / 2, y)
    return best[1] if best else tuple(poly[0])


def overlap(a, b) -> bool:
    return intersects(a, b) or contains_point(a, interior_point(b)) or contains_point(b, interior_point(a))


def closest_boundary_point(poly, q):
    return min((closest_on_segment(*e, q) for e in edges(poly)), key=lambda p: distance(p, q), default=None)


def rasterize(poly, y: float) -> list[float]:
    """Where the line at height y crosses the polygon, from left to right."""
    return sorted((x1 - x0) * (y - y0) / (y1 - y0) + x0 for (x0, y0), (x1, y1) in edges(poly) if (y0 > y) != (y1 > y))


def shift(quad, dx: float, dy: float):
    return [(x + dx, y + dy) for x, y in quad]


def scale(quad, k: float):
    return [(x * k, y * k) for x, y in quad]


def rescale_corner(v: float, decimation: float) -> float:
    """A coordinate of a decimated image in the full one."""
    return v * 1.5 if decimation == 1.5 else v if not decimation else (v - 0.5) * decimation + 0.5
