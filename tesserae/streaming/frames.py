"""Detection over a stream of frames: stateless, a frame at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tesserae.detector import FRAME, Detector
from tesserae.sources import pnm

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def frame_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Frames from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def image_stream(spark: SparkSession, folder: str, glob: str = "*.{pnm,pgm,ppm,pbm}", files_per_batch: int = 64, max_frames: int | None = None) -> DataFrame:
    """Gray frames of anymap files as they arrive in a folder; no more than ``max_frames`` of them where it is given."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return pnm.decoded(files if max_frames is None else files.limit(max_frames))


def detect_stream(detector: Detector, frames: DataFrame, out: str, checkpoint: str, least_margin: float = 0.0) -> StreamingQuery:
    """Write detections as Parquet, exactly once, until all that is there is done."""
    found = detector.detect(frames).filter(f"margin >= {least_margin}")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
