"""Scenes with one marker each, rendered from the part table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tesserae import families
from tesserae.detector import FRAME

FAMILY = "tag25h9"
#: Odd, so that markers don't fall on the grid of threshold tiles, and cells stay under two tiles: the causal window blanks flat runs of two (see README).
MARGIN = 13
GRAY = 128
#: Frames that a task renders and looks at, so that no task grows with the table.
TASK = 4096
#: Side of a tilted scene.
SIDE = 116


def marker(key: int, fam: families.Family, scale: int) -> np.ndarray:
    """The key's marker, turned; cells of ``scale`` pixels."""
    return np.kron(np.rot90(families.render(fam, key % len(fam.codes)), key % 7 % 4), np.ones((scale, scale), np.uint8))


def scale_of(key: int) -> int:
    return (4, 5, 6, 7)[key % 4]


def scene(key: int, fam: families.Family) -> np.ndarray:
    """Id, scale, place and turn of the marker follow from the key."""
    tag = marker(key, fam, scale_of(key))
    n = len(tag) + 2 * MARGIN + 8
    im = np.full((n, n), GRAY, np.uint8)
    x, y = MARGIN + key % 3, MARGIN + key % 2
    im[y : y + len(tag), x : x + len(tag)] = tag
    return im


def pair_scene(key: int, first: families.Family, second: families.Family) -> np.ndarray:
    """A marker of each family side by side."""
    a, b = scene(key, first), scene(key + 1, second)
    im = np.full((max(len(a), len(b)), a.shape[1] + b.shape[1]), GRAY, np.uint8)
    im[: len(a), : a.shape[1]] = a
    im[: len(b), a.shape[1] :] = b
    return im


def grid_scene(key: int, fam: families.Family) -> np.ndarray:
    """A marker on the grid of threshold tiles, with cells of one and a half tiles."""
    tag = marker(key, fam, 6)
    im = np.full((len(tag) + 32, len(tag) + 32), GRAY, np.uint8)
    im[16 : 16 + len(tag), 16 : 16 + len(tag)] = tag
    return im


def tilted_corners(key: int) -> list[tuple[float, float]]:
    """Where the outer corners of the key's border are in its tilted scene, from the upper left clockwise."""
    return [(30.0 + key % 7, 28.0 + key % 5), (82.0 - key % 6, 31.0 + key % 4), (86.0 + key % 3, 83.0 - key % 5), (28.0 + key % 4, 79.0 + key % 6)]


def tilted_scene(key: int, fam: families.Family, noise: float = 3.0) -> np.ndarray:
    """The key's marker in perspective, blurred by sampling nine places a pixel, with noise from the key."""
    from tesserae.operators import kernels

    ring = (fam.total_width - fam.width_at_border) // 2
    tag = families.render(fam, key % len(fam.codes))
    lo, hi = ring, fam.total_width - ring
    border = np.array([(lo, lo), (hi, lo), (hi, hi), (lo, hi)], np.float64)
    forth, back = kernels.homography(np.array(tilted_corners(key)), border), kernels.homography(border, np.array(tilted_corners(key)))
    # Only the box around the tag is looked at; all else is gray.
    out = kernels.project(forth, np.array([(0, 0), (fam.total_width, 0), (fam.total_width, fam.total_width), (0, fam.total_width)], np.float64))
    (x0, y0), (x1, y1) = np.clip(np.floor(out.min(0)) - 1, 0, SIDE).astype(int), np.clip(np.ceil(out.max(0)) + 1, 0, SIDE).astype(int)
    x, y = np.meshgrid((np.arange(x0 * 3, x1 * 3) + 0.5) / 3, (np.arange(y0 * 3, y1 * 3) + 0.5) / 3)
    cell = np.floor(kernels.project(back, np.stack([x.ravel(), y.ravel()], 1)))
    u, w = cell[:, 0], cell[:, 1]
    inside = (u >= 0) & (u < fam.total_width) & (w >= 0) & (w < fam.total_width)
    nine = np.where(inside, tag.ravel()[np.where(inside, w * fam.total_width + u, 0).astype(np.int32)], np.uint8(GRAY)).reshape(x.shape)
    v = np.full((SIDE, SIDE), float(GRAY))
    v[y0:y1, x0:x1] = sum(nine[i::3, j::3].astype(np.int64) for i in range(3) for j in range(3)) / 9
    v = 128 + (v - 128) * 0.7 + np.random.default_rng(key).normal(0, noise, v.shape)
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def frames(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = (FAMILY,), make=scene) -> DataFrame:
    """One frame a part. The few key rows are dealt to all cores first, and to more tasks where there are more: at most some :data:`TASK` frames each."""

    def run(batches):
        import pyarrow as pa

        fams = [families.family(n) for n in names]
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                keys = batch.column(0)[start : start + 64].to_pylist()
                ims = [make(k, *fams) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([i.shape[1] for i in ims], pa.int32()), pa.array([i.shape[0] for i in ims], pa.int32()), pa.array([i.tobytes() for i in ims], pa.binary())],
                    names=["image_id", "width", "height", "data"],
                )

    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-keys.count() // TASK))  # the count reads footers only
    return keys.repartition(tasks).mapInArrow(run, FRAME)
