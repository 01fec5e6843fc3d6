"""Images and measurements derived from the relational test tables.

Pixel tables have the columns image_id, w, h, x, y, v; every image of one
bridge has the same size, so width and height are literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images: one embedding each, quantised to 0..255."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    v = F.floor((F.col("e").cast("double") + F.lit(0.5)) * 255)
    return e.select("image_id", F.lit(8).alias("w"), F.lit(8).alias("h"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int").alias("v"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 x 80 images: 10 x 10 of :func:`frames8`."""
    f, cell = frames8(spark, sf_dir), F.col("image_id") % 100
    return f.select(
        F.floor(F.col("image_id") / 100).alias("image_id"), F.lit(80).alias("w"), F.lit(80).alias("h"),
        ((cell % 10) * 8 + F.col("x")).cast("int").alias("x"), (F.floor(cell / 10) * 8 + F.col("y")).cast("int").alias("y"), "v",
    )


def mosaic_x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """320 x 320 images: every pixel of :func:`mosaic` four by four times."""
    m = mosaic(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return m.select("image_id", F.lit(320).alias("w"), F.lit(320).alias("h"), (F.col("x") * 4 + F.col("k") % 4).alias("x"), (F.col("y") * 4 + F.floor(F.col("k") / 4).cast("int")).alias("y"), "v")


def frames_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`mosaic` cut to 78 x 77, so that tiles at two sides are partial."""
    return mosaic(spark, sf_dir).filter("x < 78 AND y < 77").withColumn("w", F.lit(78)).withColumn("h", F.lit(77))


def observed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit words from order keys."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", ((F.col("o_orderkey") * 40503 + F.col("o_custkey") * 977) % 65536).alias("word"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of a benchmark: label, image_id, iter, seq, stage, wall_ms, cpu_ms (may be null), ts."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("label"), (F.col("user_id") % 7).alias("image_id"), F.floor(F.col("event_id") / 50).alias("iter"), (F.col("event_id") % 50).alias("seq"),
        F.concat(F.lit("stage"), (F.col("event_id") % 5).cast("string")).alias("stage"), F.round(F.col("value") * 100).cast("bigint").alias("wall"),
        F.when(F.col("user_id") % 11 != 0, F.round(F.col("value") * 70).cast("bigint")).alias("cpu"), "ts", "event_id",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-parallel integer detections from customers: pairs of one tag that may overlap."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    x0, y0, s = (k * 7919) % 40, (k * 104729) % 40, 10 + k % 17
    return c.select(
        k.alias("det"), F.floor(k / 2).alias("image_id"), F.lit("tag16h5").alias("family"), (F.floor(k / 2) % 30).cast("int").alias("id"), (k % 3).cast("int").alias("hamming"),
        ((k * 31) % 64).cast("double").alias("margin"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), s.cast("double").alias("side"),
    )
