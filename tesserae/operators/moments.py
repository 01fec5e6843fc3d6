"""Moments, lines and corner candidates of ordered points, per cluster.

Points are rows with x, y and a weight w. A cluster is bounded by its image (four times width plus height),
so windows over one cluster are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
MOMENTS = ("sw", "swx", "swy", "swxx", "swxy", "swyy")


def _terms() -> dict[str, Column]:
    w, x, y = c("w"), c("x"), c("y")
    return dict(zip(MOMENTS, (w, w * x, w * y, w * x * x, w * x * y, w * y * y), strict=True))


def prefix_moments(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``points`` with running sums of w, wx, wy, wxx, wxy and wyy."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumns({n: F.sum(e).over(upto) for n, e in _terms().items()})


def range_moments(points: DataFrame, by: list[str], order: list[str], reach: int) -> DataFrame:
    """``points`` of clusters of more than ``2 * reach`` points, with sums over each point and ``reach`` neighbours on either side, around the end.

    Prefix sums differ over a range; a range around the end adds the whole cluster's sum.
    """
    cluster = Window.partitionBy(*by)
    ordered = cluster.orderBy(*order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"__i": F.row_number().over(ordered), "__n": F.count(F.lit(1)).over(cluster)}).filter(c("__n") > 2 * reach)
    p = prefix_moments(p, by, order)
    sums = F.collect_list(F.struct(*MOMENTS)).over(whole)
    p = p.withColumn("__sums", sums)
    first, last = (c("__i") - reach - 1) % c("__n"), (c("__i") + reach - 1) % c("__n")
    first = F.when(first < 0, first + c("__n")).otherwise(first)  # from first to last, counted from 0
    at = lambda i, n: F.when(i < 0, F.lit(0)).otherwise(F.element_at("__sums", F.greatest(i, F.lit(0)).cast("int") + 1)[n])
    made = {n: at(last, n) - at(first - 1, n) + F.when(first > last, at(c("__n") - 1, n)).otherwise(0) for n in MOMENTS}
    return p.select(*points.columns, *[v.alias(n) for n, v in made.items()])


def line(sw: Column, swx: Column, swy: Column, swxx: Column, swxy: Column, swyy: Column) -> dict[str, Column]:
    """Centre, normal and mean squared error of the line through points with these moments.

    All is worked out on the covariance times sw * sw and divided once: sums of whole numbers stay whole (below 2^53), so an error that
    is a decimal fraction comes out as that, and points in one place or alike in all directions have no normal.
    """
    cxx, cxy, cyy = swxx * sw - swx * swx, swxy * sw - swx * swy, swyy * sw - swy * swy
    root = F.sqrt((cxx - cyy) * (cxx - cyy) + cxy * cxy * 4)
    low, high = cxx + cyy - root, (cxx + cyy + root) * 0.5
    na, nb = (cxx - high) * (cxx - high) + cxy * cxy, (cyy - high) * (cyy - high) + cxy * cxy
    nx, ny = F.when(na > nb, cxx - high).otherwise(cxy), F.when(na > nb, cxy).otherwise(cyy - high)
    length = F.sqrt(F.greatest(na, nb))
    over = F.when(length > 0, length)
    return {"ex": swx / sw, "ey": swy / sw, "nx": F.coalesce(nx / over, F.lit(0.0)), "ny": F.coalesce(ny / over, F.lit(0.0)), "mse": low / (sw * sw * 2)}


def cluster_lines(points: DataFrame, by: list[str]) -> DataFrame:
    """One line for each cluster, from sums that Spark combines before the shuffle."""
    g = points.groupBy(*by).agg(*[F.sum(e).cast("double").alias(n) for n, e in _terms().items()])
    return g.select(*by, *[v.alias(n) for n, v in line(*map(c, MOMENTS)).items()])


def slope_key(points: DataFrame, by: list[str]) -> DataFrame:
    """``points`` with the key that orders them around the middle of their cluster's box, moved a little so that no point lies on it.

    The key is the quadrant's base plus the slope in the quadrant, so it rises with the angle from minus pi.
    """
    cluster = Window.partitionBy(*by)
    middle = lambda v, off: (F.min(v).over(cluster) + F.max(v).over(cluster)) * 0.5 + off
    p = points.withColumns({"__dx": c("x") - middle("x", 0.05118), "__dy": c("y") - middle("y", -0.028581)})
    dx, dy = c("__dx"), c("__dy")
    base = F.when(dy > 0, F.when(dx > 0, 65536.0).otherwise(131072.0)).otherwise(F.when(dx > 0, 0.0).otherwise(-65536.0))
    alike = (dx > 0) == (dy > 0)  # first and third quadrant: dy / dx rises; else -dx / dy does
    return p.withColumn("slope_key", base + F.when(alike, dy / dx).otherwise(-dx / dy)).drop("__dx", "__dy")


def local_maxima(points: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Points with more than either neighbour, around the end."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"__a": F.coalesce(F.lag(value).over(ordered), F.last(value).over(whole)), "__b": F.coalesce(F.lead(value).over(ordered), F.first(value).over(whole))})
    return p.filter((c(value) > c("__a")) & (c(value) > c("__b"))).drop("__a", "__b")


def top_maxima(maxima: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """Maxima above the ``most`` + 1st; equal ones go together, so fewer may stay."""
    held = F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(F.desc(value)))  # with ties
    return maxima.withColumn("__held", held).filter(c("__held") <= most).drop("__held")
