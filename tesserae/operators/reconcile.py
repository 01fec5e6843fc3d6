"""Overlapping detections of one tag: the better one stays.

Groups are the detections of one tag in one image, so a task holds a handful of rows; a tag
that one image shows often is bounded by that image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geometry

ORDER = ("hamming", "-margin")


def better_key(d: dict) -> tuple:
    """Sorts the preferred detection first: fewer errors, larger margin, then corner coordinates."""
    return (d["hamming"], -d["margin"], *[v for p in d["corners"] for v in p])


def greedy(rows: list[dict]) -> list[dict]:
    """Survivors of pairwise comparison in a fixed order."""
    rows = sorted(rows, key=lambda d: (*[v for p in d["corners"] for v in p], d["hamming"], -d["margin"]))
    gone = [False] * len(rows)
    for i, a in enumerate(rows):
        if gone[i]:
            continue
        for j in range(i + 1, len(rows)):
            if gone[j] or not geometry.overlap(a["corners"], rows[j]["corners"]):
                continue
            if better_key(a) <= better_key(rows[j]):
                gone[j] = True
            else:
                gone[i] = True
                break
    return [d for d, g in zip(rows, gone, strict=True) if not g]


def reconcile(detections: DataFrame) -> DataFrame:
    """Rows with image_id, family, id, hamming, margin and corners (array of 8 numbers) that survive.

    Most tags stand once in an image: those rows stay in the JVM. The others go to Python, many groups in one batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, target = detections.schema, to_arrow_schema(detections.schema)
    groups = detections.groupBy("image_id", "family", "id").agg(F.collect_list(F.struct(*detections.columns)).alias("__rows"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = []
            for rows in batch.column(0).to_pylist():
                kept += greedy([r | {"corners": [tuple(r["corners"][i : i + 2]) for i in range(0, 8, 2)]} for r in rows])
            if kept:
                yield pa.RecordBatch.from_pylist([r | {"corners": [v for p in r["corners"] for v in p]} for r in kept], schema=target)

    alone = groups.filter(F.size("__rows") == 1).select("__rows").selectExpr("inline(__rows)")
    return alone.union(groups.filter(F.size("__rows") > 1).select("__rows").mapInArrow(run, schema))


def in_order(detections: DataFrame, *ties: str) -> DataFrame:
    """``detections`` with their place in their image: by id, family, errors, margin from the largest, then ``ties``."""
    order = Window.partitionBy("image_id").orderBy("id", "family", "hamming", F.desc("margin"), *ties)
    return detections.withColumn("place", F.row_number().over(order))


def with_margin(detections: DataFrame, least: float) -> DataFrame:
    """Detections of at least that margin."""
    return detections.filter(F.col("margin") >= least)


def without(rows: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``drop``."""
    return rows.join(drop.select(key).distinct(), key, "left_anti")


def best_of_tag(detections: DataFrame) -> DataFrame:
    """The preferred detection of each tag in each image, by one aggregate."""
    others = [n for n in detections.columns if n not in ("image_id", "family", "id")]
    best = detections.groupBy("image_id", "family", "id").agg(F.min_by(F.struct(*others), F.struct("hamming", -F.col("margin"), "det")).alias("b"))
    return best.select("image_id", "family", "id", "b.*")
