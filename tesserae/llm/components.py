"""Connected components over an edge table (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """node, label for every node of an edge; label is the least node of its component."""
    found = stars(edges, a, b, most_rounds)
    return found.union(found.select("label", "label").distinct())


def stars(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """node, label for every node of an edge but the least of each component, which is the others' label.

    Every round links neighbours straight to their least neighbour, so the number of rounds
    grows with the logarithm of a component's size.  Rounds are written to the shared
    folder; two counts a round are all that the driver reads.  Only minima are
    taken per node, which Spark combines before the shuffle; edges meet their node's minimum by
    :func:`common.join_skewed`, so the edges of a star's centre are never in one task.
    """
    spark = edges.sparkSession
    now = common.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        count, loose = _state(now)
        if not loose:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now.inputFiles()
        both = now.union(now.select(F.col("v"), F.col("u")))  # large star: higher neighbours to the least one
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = common.join_skewed(both, least, "u", "n", 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))  # small star: lower neighbours to the least one
        small = common.join_skewed(large, least, "u", "n", count).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = common.written(small.filter("u <> v").distinct(), "edges")
        for files in (before, large.inputFiles()):
            if files:
                common.drop_path(spark, files[0].rsplit("/", 1)[0])
    raise RuntimeError("components did not settle")


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes that keep them from being stars: with two lower neighbours, or with lower and higher ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    count, loose = ends.agg(F.sum("low"), F.count_if((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("high") > 0)))).first()
    return count or 0, loose
