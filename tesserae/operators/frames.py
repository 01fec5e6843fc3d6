"""Image operators over frames: one row an image (image_id, width, height, data).

A frame that lacks pixels may say so in a column ``known`` (a byte a pixel, 0 where it is missing; null for whole frames): :func:`pack`
makes it, and :func:`unpack` and :func:`labels` have rows of known pixels only. Nothing here shuffles; :func:`pack` is the one step that gathers pixel rows, an image at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import kernels

FRAME = "image_id bigint, width int, height int, data binary"
KNOWN = f"{FRAME}, known binary"


def pack(px: DataFrame) -> DataFrame:
    """Frames from pixel rows; missing pixels are 0, and not ``known``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, ws, hs, ats, vs = (batch.column(i).to_pylist() for i in range(5))
            data, known = [], []
            for w, h, at, v in zip(ws, hs, ats, vs, strict=True):
                im, have = np.zeros(w * h, np.uint8), np.zeros(w * h, np.uint8)
                im[np.array(at, np.int64)] = np.array(v, np.int64)
                have[np.array(at, np.int64)] = 1
                data.append(im.tobytes())
                known.append(None if have.all() else have.tobytes())
            yield _batch(ids, ws, hs, data, known)

    rows = F.collect_list(F.struct((F.col("y") * F.col("w") + F.col("x")).cast("int").alias("at"), F.col("v").cast("int").alias("v")))
    gathered = px.groupBy("image_id", "w", "h").agg(rows.alias("p")).select(F.col("image_id").cast("bigint"), "w", "h", "p.at", "p.v")
    return gathered.mapInArrow(run, KNOWN)


def _columns(frames: DataFrame) -> DataFrame:
    known = F.col("known") if "known" in frames.columns else F.lit(None).cast("binary").alias("known")
    return frames.select("image_id", "width", "height", "data", known)


def _batch(ids, ws, hs, data, known):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ws, pa.int32()), pa.array(hs, pa.int32()), pa.array(data, pa.binary()), pa.array(known, pa.binary())], names=["image_id", "width", "height", "data", "known"])


def _images(batches):
    """Key, image and known pixels (None: all) of each frame."""
    for batch in batches:
        ids, ws, hs, data, known = (batch.column(i) for i in range(5))
        for i in range(batch.num_rows):
            w, h = ws[i].as_py(), hs[i].as_py()
            image = lambda c, i=i, w=w, h=h: np.frombuffer(c[i].as_buffer(), np.uint8)[: w * h].reshape(h, w)
            yield ids[i].as_py(), image(data), image(known) != 0 if known[i].is_valid else None


def _stacks(batches):
    """Keys, stacks and known pixels (None: all) of the frames of one size in each batch."""
    for batch in batches:
        every = list(_images([batch]))
        for places in kernels.stacks([im for _, im, _ in every]):
            own = [every[i] for i in places]
            known = None if all(k is None for _, _, k in own) else np.stack([np.ones(im.shape, bool) if k is None else k for _, im, k in own])
            yield [key for key, _, _ in own], np.stack([im for _, im, _ in own]), known


def _map(frames: DataFrame, f: Callable) -> DataFrame:
    def run(batches):
        for keys, stack, known in _stacks(batches):
            out, known = f(stack, known)
            out = np.ascontiguousarray(out, np.uint8)
            n, h, w = out.shape
            if known is not None and known.shape != out.shape:
                raise ValueError("an image function that changes sizes takes whole frames only")
            have = [None] * n if known is None else [None if k.all() else k.astype(np.uint8).tobytes() for k in known]
            yield _batch(keys, np.full(n, w, np.int32), np.full(n, h, np.int32), [i.tobytes() for i in out], have)

    return _columns(frames).mapInArrow(run, KNOWN)


def map_frames(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply an image function to every frame; it takes stacks of frames of one size as well, and missing pixels as 0."""
    return _map(frames, lambda im, known: (f(im), known))


def threshold(frames: DataFrame, least: int = 5) -> DataFrame:
    """Ternary frames; missing pixels have no part in a tile's range, and pixels whose tile has none are missing as well."""
    return _map(frames, lambda im, known: (kernels.threshold(im, least, known=known), known if known is None else kernels.in_known_tiles(known)))


def unpack(frames: DataFrame) -> DataFrame:
    """Pixel rows of frames."""

    def run(batches):
        import pyarrow as pa

        for key, im, known in _images(batches):
            h, w = im.shape
            at = np.arange(im.size, dtype=np.int32) if known is None else np.flatnonzero(known)
            y, x = np.divmod(at, w)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), *(pa.array(a.astype(np.int32)) for a in (np.full(n, w), np.full(n, h), x, y, im.ravel()[at]))], names=["image_id", "w", "h", "x", "y", "v"])

    return _columns(frames).mapInArrow(run, "image_id bigint, w int, h int, x int, y int, v int")


def labels(ternary: DataFrame) -> DataFrame:
    """Pixel rows (image_id, w, h, x, y, v, pix_id) with the component of every pixel, named by its least pixel (rep), and its size."""

    def run(batches):
        import pyarrow as pa

        for keys, stack, known in _stacks(batches):
            n, h, w = stack.shape
            stack = stack if known is None else np.where(known, stack, np.uint8(127))  # which links to nothing
            rep, size = kernels.components(stack)
            at = np.arange(stack.size) if known is None else np.flatnonzero(known)
            frame, pix = np.divmod(at, h * w)
            y, x = np.divmod(pix, w)
            small = [pa.array(a.astype(np.int32)) for a in (np.full(len(at), w), np.full(len(at), h), x, y, stack.ravel()[at])]
            wide = [pa.array(a) for a in (pix, rep.ravel()[at] - frame * (h * w), size.ravel()[at])]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[frame]), *small, *wide], names=["image_id", "w", "h", "x", "y", "v", "pix_id", "rep", "size"])

    return _columns(ternary).mapInArrow(run, "image_id bigint, w int, h int, x int, y int, v int, pix_id bigint, rep bigint, size bigint")
