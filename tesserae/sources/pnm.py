"""Portable anymaps: binary P4, P5 and P6, with 8 or 16 bits a sample.

:func:`read_frames` reads files of this kind through Spark's ``binaryFile`` source into frames;
the ``pnm`` DataSource does the same under ``spark.read.format("pnm")``.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


class PnmError(ValueError):
    """A file isn't a readable anymap."""


def parse(data: bytes) -> np.ndarray:
    """Samples as uint8 or uint16: [y, x] for P4 and P5, [y, x, channel] for P6. P4 has 0 for black and 255 for white."""
    kind = data[:2]
    if kind not in (b"P4", b"P5", b"P6"):
        raise PnmError("not a binary anymap")
    at, numbers = 2, []
    for _ in range(2 if kind == b"P4" else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise PnmError("a header field is missing")
        numbers.append(int(m[1]))
        at = m.end()
    at += 1  # one blank after the header
    w, h = numbers[:2]
    if kind == b"P4":
        row = -(-w // 8)
        raw = np.frombuffer(_need(data, at, row * h), np.uint8).reshape(h, row)
        return np.where(np.unpackbits(raw, axis=1)[:, :w] == 1, 0, 255).astype(np.uint8)
    if numbers[2] not in (255, 65535):
        raise PnmError(f"a maximum of {numbers[2]} isn't supported")
    kind_of = np.dtype(np.uint8) if numbers[2] == 255 else np.dtype(">u2")
    shape = (h, w, 3) if kind == b"P6" else (h, w)
    return np.frombuffer(_need(data, at, int(np.prod(shape)) * kind_of.itemsize), kind_of).reshape(shape).astype(kind_of.newbyteorder("="))


def _need(data: bytes, at: int, n: int) -> bytes:
    if len(data) - at < n:
        raise PnmError("the samples are cut off")
    return data[at : at + n]


def to_luma(samples: np.ndarray) -> np.ndarray:
    """Gray: the high byte of 16-bit samples; (r + 2 g + b) / 4 of colour."""
    if samples.dtype != np.uint8:
        samples = (samples >> 8).astype(np.uint8)
    if samples.ndim == 3:
        wide = samples.astype(np.uint16)
        return ((wide[..., 0] + 2 * wide[..., 1] + wide[..., 2]) // 4).astype(np.uint8)
    return samples


def to_rgb(samples: np.ndarray) -> np.ndarray:
    if samples.dtype != np.uint8:
        samples = (samples >> 8).astype(np.uint8)
    return samples if samples.ndim == 3 else np.repeat(samples[..., None], 3, 2)


def write(im: np.ndarray) -> bytes:
    """P5 of a gray image, P6 of a colour one."""
    return b"P%d\n%d %d\n255\n" % (6 if im.ndim == 3 else 5, im.shape[1], im.shape[0]) + np.ascontiguousarray(im, np.uint8).tobytes()


FRAMES = "path string, image_id bigint, width int, height int, data binary"


def _frame_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            path, key, data = (batch.column(j)[i].as_py() for j in range(3))
            im = to_luma(parse(data))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([key], pa.int64()), pa.array([im.shape[1]], pa.int32()), pa.array([im.shape[0]], pa.int32()), pa.array([im.tobytes()], pa.binary())], names=["path", "image_id", "width", "height", "data"])


def read_frames(spark: SparkSession, folder: str, glob: str = "*.{pnm,pgm,ppm,pbm}") -> DataFrame:
    """Gray frames of a folder's anymaps; image_id is a hash of the path. Raises where there is no file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    if files.isEmpty():
        raise FileNotFoundError(f"no image in {folder}")
    return decoded(files)


def decoded(files: DataFrame) -> DataFrame:
    """Gray frames of ``binaryFile`` rows of anymaps, also of a stream."""
    return files.select("path", F.xxhash64("path").alias("image_id"), "content").mapInArrow(_frame_rows, FRAMES)


def read_images(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """Gray frames of PNG and JPEG files, decoded on the JVM by Spark's ``image`` source."""
    im = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob).load(folder).select("image.*")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                gray = a[..., 0] if r["nChannels"] == 1 else to_luma(np.ascontiguousarray(a[..., 2::-1]))
                yield pa.RecordBatch.from_arrays([pa.array([r["origin"]]), pa.array([r["image_id"]], pa.int64()), pa.array([r["width"]], pa.int32()), pa.array([r["height"]], pa.int32()), pa.array([np.ascontiguousarray(gray).tobytes()], pa.binary())], names=["path", "image_id", "width", "height", "data"])

    return im.withColumn("image_id", F.xxhash64("origin")).mapInArrow(run, FRAMES)


def save_frames(frames: DataFrame, folder: str) -> int:
    """Write every frame as ``<image_id>.pnm`` to a folder that all executors share. A file appears whole, also where a task runs twice."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        n = 0
        for batch in batches:
            for r in batch.select(["image_id", "width", "height", "data"]).to_pylist():
                new = f"{base}/.{r['image_id']}.{uuid.uuid4().hex}"
                with store.open_output_stream(new) as out:
                    out.write(write(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"])))
                store.move(new, f"{base}/{r['image_id']}.pnm")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return frames.mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options.get("path"), int(options.get("partitions", 64))

    def partitions(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        every = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.rsplit(".", 1)[-1] in ("pnm", "pgm", "ppm", "pbm"))
        return [_Part(every[i :: self.parts]) for i in range(min(self.parts, len(every)))] or [_Part([])]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for path in partition.paths:
            with store.open_input_file(path) as f:
                im = to_luma(parse(f.read()))
            yield path, im.shape[1], im.shape[0], im.tobytes()


class PnmSource(DataSource):
    """``spark.dataSource.register(PnmSource)``, then ``spark.read.format("pnm").load(folder)``."""

    @classmethod
    def name(cls):
        return "pnm"

    def schema(self):
        return "path string, width int, height int, data binary"

    def reader(self, schema):
        return _Reader(self.options)
