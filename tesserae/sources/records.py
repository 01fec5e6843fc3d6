"""Benchmark records: JSON lines in and out, and PostScript of an image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import analytics


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Long rows of the runs in files of JSON lines; blank and malformed lines are left out."""
    return analytics.from_records(spark.read.text(list(paths)).filter(F.trim("value") != ""))


def malformed(spark: SparkSession, *paths: str) -> DataFrame:
    """Number of lines that :func:`read_runs` leaves out because they can't be read (lines, path), for a warning; files without such are absent."""
    text = spark.read.text(list(paths)).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("path"))
    return text.filter(F.from_json("value", analytics.RUN_SCHEMA)["label"].isNull()).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


def append_runs(rows: DataFrame, folder: str) -> None:
    """Append one JSON document a run."""
    analytics.to_records(rows).write.mode("append").text(folder)


def postscript(im: np.ndarray, lines: list[tuple[float, float, float, float]] = ()) -> str:
    """A page with the image and line segments (x0, y0, x1, y1) in image coordinates."""
    h, w = im.shape
    data = np.ascontiguousarray(im, np.uint8).tobytes().hex()
    out = ["%!PS", f"{w} {h} scale", f"{w} {h} 8 [{w} 0 0 -{h} 0 {h}]", "{<", *[data[i : i + 72] for i in range(0, len(data), 72)], ">} image", f"{1 / w} {1 / h} scale", "1 0 0 setrgbcolor"]
    out += [f"{x0} {h - y0} moveto {x1} {h - y1} lineto stroke" for x0, y0, x1, y1 in lines]
    return "\n".join([*out, "showpage", ""])


def draw_line(im: np.ndarray, p, q, value: int = 255, width: int = 1) -> np.ndarray:
    """A copy with a segment in steps of half a pixel, one or two pixels wide."""
    out = im.copy()
    n = max(1, int(np.ceil(2 * np.hypot(q[0] - p[0], q[1] - p[1]))))
    t = np.arange(n + 1) / n
    x, y = (p[0] + t * (q[0] - p[0])).astype(int), (p[1] + t * (q[1] - p[1])).astype(int)
    for dx in range(width):
        for dy in range(width):
            ok = (x + dx >= 0) & (x + dx < im.shape[1]) & (y + dy >= 0) & (y + dy < im.shape[0])
            out[y[ok] + dy, x[ok] + dx] = value
    return out
