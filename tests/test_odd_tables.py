"""Tables whose rows don't fill images, or sum to nothing, and keys beyond the small ones."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tesserae import families
from tesserae.config import DetectorConfig, QuadParams
from tesserae.detector import _Reader, detect_one
from tesserae.operators import analytics, frames, moments, pixels
from tesserae.sources import scenes

ENTRY = __import__("__spark_entry__")


@pytest.fixture(scope="module")
def holes(spark, tmp_path_factory):
    """Embeddings of two mosaics: one without its last rows of cells, one without some in the middle."""
    import duckdb

    folder, con = str(tmp_path_factory.mktemp("holes")), duckdb.connect()
    gone = [*range(57, 100), 117, 144, 145, 146, 155, 199]
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter(f"vec_id < 200 AND NOT vec_id IN ({', '.join(map(str, gone))})")
    rows.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return con, folder


def test_shares_of_a_total_of_zero(spark):
    rows = [("a", 1, 0, 0, 5), ("a", 1, 0, 1, -5), ("a", 1, 0, 2, -1), ("a", 1, 0, 3, 1), ("b", 1, 0, 0, 0), ("c", 1, 0, 0, 1), ("c", 1, 0, 1, 3), ("d", 1, 0, 0, None)]
    df = spark.createDataFrame(rows, "label string, image_id int, iter int, seq int, wall bigint")
    got = {(r["label"], r["seq"]): (r["cumulative"], r["pct"]) for r in analytics.cumulative(df).collect()}
    assert [got["a", i] for i in (0, 2)] == [(5, math.inf), (-1, -math.inf)] and [got["c", i] for i in (0, 1)] == [(1, 25.0), (4, 100.0)]
    assert all(got[k][0] == 0 and math.isnan(got[k][1]) for k in (("a", 1), ("a", 3), ("b", 0))) and got["d", 0] == (None, None)


def _query_equals_sql(spark, duck, folder, name):
    df, want = ENTRY.queries()[name](spark, folder), duck.sql(ENTRY.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want.select(*columns).fetchall())


@pytest.mark.parametrize("name", ["blur_h", "blur_sep", "sharpen", "image_diff"])
def test_blurs_of_images_that_lack_pixels(spark, holes, name):
    _query_equals_sql(spark, *holes, name)


@pytest.mark.parametrize("name", ["threshold_arrow", "threshold_odd"])
def test_thresholds_of_images_that_lack_pixels(spark, holes, name):
    _query_equals_sql(spark, *holes, name)


def test_forms_agree_where_pixels_are_missing(spark):
    """Whole cells, single pixels and all of some tiles are missing; the last row and column are partial tiles."""
    rng, w, h = np.random.default_rng(3), 22, 19
    rows = [(i, w, h, x, y, int(rng.integers(0, 256))) for i in range(6) for y in range(h) for x in range(w) if i % 3 == 0 or (rng.random() > 0.3 and not (i == 1 and x // 4 in (1, 4)) and not (i == 4 and y // 4 in (0, 3)))]
    px = spark.createDataFrame(rows, "image_id bigint, w int, h int, x int, y int, v int")
    assert sorted(map(tuple, frames.unpack(frames.pack(px)).collect())) == sorted(rows)
    slow, fast = pixels.threshold(px), frames.threshold(frames.pack(px))
    assert sorted(map(tuple, frames.unpack(fast).collect())) == sorted(map(tuple, slow.collect()))
    found = {(r["image_id"], r["y"] * w + r["x"]): r["rep"] for r in frames.labels(fast).collect()}
    assert len(found) == slow.count() < len(rows)
    assert all(found[i, rep] == rep for (i, _), rep in found.items())


def test_sizes_change_for_whole_frames_only(spark):
    px = spark.createDataFrame([(1, 4, 4, x, y, 9) for y in range(4) for x in range(4)] + [(2, 4, 4, 0, 0, 9)], "image_id bigint, w int, h int, x int, y int, v int")
    half = lambda p: frames.map_frames(frames.pack(p), lambda im: im[..., ::2, ::2]).collect()
    assert [(r["width"], bytes(r["data"]), r["known"]) for r in half(px.filter("image_id = 1"))] == [(2, b"\x09" * 4, None)]
    with pytest.raises(Exception, match="whole frames only"):
        half(px)


def test_line_errors_that_are_decimal_fractions(spark):
    """Of 312.1875 and 44.6875 the third decimal hangs on the last bit; points in one place have no normal."""
    points = {1: [(50, 33, 5), (4, 50, 5), (41, 87, 2)], 2: [(40, 0, 1), (14, 78, 3), (29, 88, 5), (27, 39, 3)], 3: [(49, 97, 3)] * 3}
    df = spark.createDataFrame([(k, *p) for k, ps in points.items() for p in ps], "k int, x bigint, y bigint, w bigint")
    got = {r["k"]: r for r in moments.cluster_lines(df, ["k"]).collect()}
    assert [got[k]["mse"] for k in (1, 2, 3)] == [312.1875, 44.6875, 0.0]
    assert [round(math.hypot(got[k]["nx"], got[k]["ny"]), 9) for k in (1, 2, 3)] == [1, 1, 0]


def test_noise_is_no_marker():
    """Beside the marker of this scene lies noise whose word is two bits from a code."""
    config, read = DetectorConfig(qtp=QuadParams(full_blur=True)), [_Reader(families.family("tag36h11"), 2)]
    im = scenes.tilted_scene(49230, read[0].family)
    assert [(d["id"], d["hamming"]) for d in detect_one(im, config, read)] == [(49230 % 587, 0)]
    faint = np.rint((im - 128.0) / 15 + 128).astype(np.uint8)  # a marker of little contrast is found still
    assert [(d["id"], d["hamming"]) for d in detect_one(faint, config, read)] == [(49230 % 587, 0)]


def test_tasks_of_scenes_grow_in_number_only(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(scenes, "TASK", 50)
    rows = scenes.frames(spark, str(tmp_path)).select("image_id").withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("image_id").alias("n"), F.sum("image_id").alias("s")).collect()
    assert len(rows) == 20 and max(r["n"] for r in rows) <= 60 and sum(r["s"] for r in rows) == 999 * 500
