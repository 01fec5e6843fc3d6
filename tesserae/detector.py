"""Detection over a table of frames: a builder, and ``detect``.

A frame is one row (image_id, width, height, data).  The whole of detection is one ``mapInArrow``
without a shuffle: parallelism is over frames, and a frame never crosses tasks.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from tesserae import families
from tesserae.config import ConfigError, DetectorConfig
from tesserae.functions import geometry
from tesserae.operators import kernels, reconcile

DETECTION = StructType([
    StructField("image_id", LongType()), StructField("family", StringType()), StructField("id", IntegerType()), StructField("hamming", IntegerType()), StructField("margin", FloatType()),
    StructField("h", ArrayType(DoubleType())), StructField("center", ArrayType(DoubleType())), StructField("corners", ArrayType(DoubleType())),
])
FRAME = "image_id bigint, width int, height int, data binary"
SMALLEST = 8


class _Reader:
    """Lookup of codewords of one family, on an executor."""

    def __init__(self, fam: families.Family, errors: int):
        self.family, self.errors = fam, errors
        self.bits = np.array(fam.bits)
        self.codes = np.array(fam.need_codes(), np.uint64)

    def find(self, words: np.ndarray) -> list[tuple[int, int, int] | None]:
        """id, Hamming distance and rotation of each word's first match."""
        if not len(words):
            return []
        turned = np.stack(families.rotations(words.astype(np.uint64), len(self.bits)), 1)
        out: list[tuple[int, int, int] | None] = [None] * len(words)
        for turn in (3, 2, 1, 0):  # the first rotation with a match is written last
            d = np.bitwise_count(self.codes ^ turned[:, turn, None])
            near = d <= self.errors
            at = near.argmax(1)
            for i in np.flatnonzero(near.any(1)):
                out[i] = int(at[i]), int(d[i, at[i]]), turn
        return out

    def __call__(self, word: int) -> tuple[int, int, int] | None:
        return self.find(np.array([word], np.uint64))[0]


#: Quadrilaterals that are refined and read at once: what they need of memory is bounded by this and the longest side.
QUADS = 64
#: Pixels of the frames of a batch that are looked at together, to be put into stacks by size.
SLICE = 1 << 22


def _turned(h: np.ndarray, turns: int) -> np.ndarray:
    """The homography after a turn by minus ``turns`` quarters, which is the convention that results follow."""
    c, s = [(1, 0), (0, 1), (-1, 0), (0, -1)][(4 - turns) % 4]
    return h @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])


def detect_stack(im: np.ndarray, config: DetectorConfig, readers: list[_Reader]) -> list[list[dict]]:
    """Detections in each of a stack of frames of one size, reconciled and ordered by id."""
    found: list[list[dict]] = [[] for _ in im]
    if min(im.shape[1:]) < SMALLEST:
        return found
    kernels.check_size(im.shape[1:])
    k = config.decimation()
    small = kernels.decimate_three_halves(im) if k == 1.5 else kernels.decimate(im, int(k)) if k else im
    small = kernels.sigma_filter(np.ascontiguousarray(small), config)
    if min(small.shape[1:]) < 4:
        return found
    t = kernels.threshold(small, config.qtp.min_white_black_diff, full_blur=config.qtp.full_blur)
    if config.qtp.deglitch:
        t = kernels.deglitch(t)
    factor = config.quad_decimate or 1.0  # as given, also where the image is decimated by its rounded value
    fams = [r.family for r in readers]
    tag_width = max(3, int(min(f.width_at_border for f in fams) / factor))
    every = kernels.find_quads(small, t, config, tag_width, any(not f.reversed_border for f in fams), any(f.reversed_border for f in fams))
    for start in range(0, len(every[0]), QUADS):
        frame, corners, flipped = (a[start : start + QUADS] for a in every)
        if k:
            corners = geometry.rescale_corner(corners, k)
        if config.refine_edges:
            corners = kernels.refine(corners, im, frame, flipped, factor + 1)
        h, sound = kernels.homographies(corners)
        for r in readers:
            f = r.family
            at = np.flatnonzero(sound & (flipped == f.reversed_border))
            if not f.geometric or not len(at):
                continue
            # A border of less contrast than a tile needs is noise, and one word in 43,000 of noise is within two bits of a 36h11 code.
            right, words, margins = kernels.read_words(im, frame[at], h[at], r.bits, f.width_at_border, f.total_width, f.reversed_border, config.decode_sharpening, config.qtp.min_white_black_diff)
            at, margins = at[right], margins[right]
            for i, margin, hit in zip(at, margins, r.find(words[right]), strict=True):
                if hit:
                    own = _turned(h[i], hit[2])
                    p = kernels.project(own, OUTLINE)
                    found[frame[i]].append({"family": f.name, "id": hit[0], "hamming": hit[1], "margin": float(margin), "h": own.ravel().tolist(), "center": p[4].tolist(), "corners": [tuple(c) for c in p[:4].tolist()]})
    return [_reconciled(rows) for rows in found]


#: The corners and the middle of a tag, in the order of results.
OUTLINE = np.array([(-1, 1), (1, 1), (1, -1), (-1, -1), (0, 0)], np.float64)


def _reconciled(found: list[dict]) -> list[dict]:
    groups: dict[tuple, list[dict]] = {}
    for d in found:
        groups.setdefault((d["id"], d["family"]), []).append(d)
    return [d for key in sorted(groups) for d in sorted(reconcile.greedy(groups[key]), key=reconcile.better_key)]


def detect_one(im: np.ndarray, config: DetectorConfig, readers: list[_Reader]) -> list[dict]:
    """Detections in one image."""
    return detect_stack(im[None], config, readers)[0]


def debug_images(im: np.ndarray, config: DetectorConfig) -> dict[str, np.ndarray]:
    """The image after each step, by name."""
    k = config.decimation()
    out = {"source": im}
    out["decimated"] = kernels.decimate_three_halves(im) if k == 1.5 else kernels.decimate(im, int(k)) if k else im
    out["filtered"] = kernels.sigma_filter(np.ascontiguousarray(out["decimated"]), config)
    out["threshold"] = kernels.threshold(out["filtered"], config.qtp.min_white_black_diff, full_blur=config.qtp.full_blur)
    if config.qtp.deglitch:
        out["deglitched"] = kernels.deglitch(out["threshold"])
    rep, _ = kernels.components(out.get("deglitched", out["threshold"]))
    out["components"] = (rep * 2654435761 >> 5 & 255).astype(np.uint8)
    return out


class Detector:
    def __init__(self, config: DetectorConfig, fams: list[tuple[families.Family, int]]):
        if not fams:
            raise ConfigError("a detector needs a family")
        self.config, self.families = config, fams

    def detect(self, frames: DataFrame) -> DataFrame:
        """Detections of all frames (image_id, width, height, data)."""
        from pyspark.sql.pandas.types import to_arrow_schema

        config, fams, target = self.config, self.families, to_arrow_schema(DETECTION)

        def run(batches):
            import pyarrow as pa

            readers = [_Reader(f, e) for f, e in fams]
            for batch in batches:
                ids, ws, hs, data = (batch.column(batch.schema.get_field_index(n)) for n in ("image_id", "width", "height", "data"))
                start = 0
                while start < batch.num_rows:
                    images, keys, pixels = [], [], 0
                    while start < batch.num_rows and (not images or pixels < SLICE):
                        image_id, w, h = (c[start].as_py() for c in (ids, ws, hs))
                        if config.source_dimensions and (w, h) != config.source_dimensions:
                            raise ConfigError(f"frame {image_id} is {w} x {h}")
                        images.append(np.frombuffer(data[start].as_buffer(), np.uint8)[: w * h].reshape(h, w))
                        keys.append(image_id)
                        pixels += w * h
                        start += 1
                    found: list[list[dict]] = [[]] * len(images)
                    for places in kernels.stacks(images):
                        for i, rows in zip(places, detect_stack(np.stack([images[i] for i in places]), config, readers), strict=True):
                            found[i] = rows
                    out = [d | {"image_id": key, "corners": [v for p in d["corners"] for v in p]} for key, rows in zip(keys, found, strict=True) for d in rows]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=target)

        return frames.select("image_id", "width", "height", "data").mapInArrow(run, DETECTION)


    def debug(self, frames: DataFrame) -> DataFrame:
        """Frames of every step (image_id, step, width, height, data), for writing aside."""
        config = self.config

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for r in batch.to_pylist():
                    im = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"])
                    out = [{"image_id": r["image_id"], "step": n, "width": i.shape[1], "height": i.shape[0], "data": np.ascontiguousarray(i).tobytes()} for n, i in debug_images(im, config).items()]
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("image_id", pa.int64()), ("step", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())]))

        return frames.select("image_id", "width", "height", "data").mapInArrow(run, "image_id bigint, step string, width int, height int, data binary")


class DetectorBuilder:
    """Collects families and parameters."""

    def __init__(self, config: DetectorConfig | None = None):
        self.config = config or DetectorConfig()
        self.families: dict[str, tuple[families.Family, int]] = {}

    def with_config(self, **changes) -> DetectorBuilder:
        self.config = replace(self.config, **changes)
        return self

    def add_family(self, fam: families.Family | str, bits_corrected: int = 2) -> DetectorBuilder:
        fam = families.family(fam) if isinstance(fam, str) else fam
        fam.need_codes()
        if not fam.geometric:
            raise families.FamilyError(f"{fam.name} has no sound geometry, so only its codewords can be looked up")
        if not 0 <= bits_corrected <= 3:
            raise families.FamilyError("from 0 to 3 bits can be corrected")
        self.families[fam.name] = (fam, bits_corrected)
        return self

    def remove_family(self, name: str) -> DetectorBuilder:
        self.families.pop(name, None)
        return self

    def clear_families(self) -> DetectorBuilder:
        self.families.clear()
        return self

    def build(self) -> Detector:
        return Detector(self.config, list(self.families.values()))
