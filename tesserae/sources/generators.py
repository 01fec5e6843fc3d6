"""Made-up images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources import pnm


def checkerboard(spark: SparkSession, width: int, height: int, cell: int, images: int = 1) -> DataFrame:
    """Pixel rows of boards that begin with black."""
    p = spark.range(images * width * height).select(
        F.floor(F.col("id") / (width * height)).alias("image_id"), F.lit(width).alias("w"), F.lit(height).alias("h"), (F.col("id") % width).cast("int").alias("x"), (F.floor(F.col("id") / width) % height).cast("int").alias("y")
    )
    return p.withColumn("v", ((F.floor(F.col("x") / cell) + F.floor(F.col("y") / cell)) % 2 * 255).cast("int"))


def noise(spark: SparkSession, width: int, height: int, images: int = 1, seed: int = 1) -> DataFrame:
    """Pixel rows with values from a hash of their place."""
    p = checkerboard(spark, width, height, 1, images)
    return p.withColumn("v", F.pmod(F.xxhash64(F.lit(seed), "image_id", "x", "y"), F.lit(256)).cast("int"))


def ramp(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Values 0, 1, 2, ... modulo 256 in scan order."""
    p = checkerboard(spark, width, height, 1)
    return p.withColumn("v", ((F.col("y") * width + F.col("x")) % 256).cast("int"))


def from_arrays(spark: SparkSession, images: dict[int, np.ndarray]) -> DataFrame:
    """Frames from two-dimensional uint8 arrays."""
    rows = []
    for key, im in images.items():
        if im.ndim != 2 or im.dtype.itemsize != 1:
            raise ValueError("an image must be two-dimensional, with one byte a sample")
        rows.append((key, im.shape[1], im.shape[0], bytearray(np.ascontiguousarray(im).tobytes())))
    return spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary")


def from_colour(spark: SparkSession, images: dict[int, np.ndarray], order: str = "rgb") -> DataFrame:
    """Gray frames from arrays [y, x, channel] in the order ``rgb`` or ``bgr``."""
    if order not in ("rgb", "bgr"):
        raise ValueError(f"no order {order!r} of channels")
    return from_arrays(spark, {k: pnm.to_luma(im if order == "rgb" else im[..., ::-1]) for k, im in images.items()})


def from_strided(frames: DataFrame, stride: str = "stride") -> DataFrame:
    """Frames whose rows are ``stride`` bytes apart, packed."""
    rows = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: F.substring(F.col("data"), i * F.col(stride) + 1, F.col("width")))
    return frames.withColumn("data", F.unhex(F.concat_ws("", F.transform(rows, F.hex)))).drop(stride)
