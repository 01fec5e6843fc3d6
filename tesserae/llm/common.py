"""Shared plumbing: written intermediate tables, bounded Arrow slices, schemas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes that a kernel works on at a time.
SLICE_BYTES = 1 << 20
#: A key with more than 1 / HOT of all rows is hot, so there are fewer than HOT of them at any size of data.
HOT = 4096

_own_dir: str | None = None
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` (or the context's checkpoint folder) names it on a cluster. Only on a local
    master, as in tests, a temporary folder of this machine serves; elsewhere its lack is an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = folder.get() if folder.isDefined() else None
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_dir(spark).rstrip('/')}/tesserae/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this process has written; for when no result is read any more."""
    while _paths:
        drop_path(spark, _paths.pop())


def join_skewed(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key and in ``count`` the number of ``rows`` with it.

    Hot keys - more than 1 / :data:`HOT` of ``total`` rows - are fewer than HOT, so their rows of ``table`` are
    broadcast and ``rows`` of a hot key never meet in one task. All others meet by a shuffle.
    ``rows`` and ``table`` are read twice. Rows whose key is null or stands in no row of ``table`` go.
    """
    hot = F.col(count) * HOT > F.lit(total)
    at_once = rows.join(F.broadcast(table.filter(hot)), key)
    others = rows.join(F.broadcast(table.filter(hot).select(key)), key, "left_anti").join(table.filter(~hot), key)
    return at_once.unionByName(others)


def replaced(schema: StructType, *fields: StructField) -> StructType:
    """``schema`` with ``fields`` at its end; same-named input columns go."""
    names = {f.name.lower() for f in fields}
    return StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of at most ``most`` bytes in ``column`` (or one row)."""
    if batch.num_rows == 0:
        return
    at = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n) + 64
    yield batch.slice(start)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as str; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_slices(df: DataFrame, schema: StructType, column: str, start: Callable[[], Callable], keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """Run a kernel over ``df`` slice by slice.

    ``start()`` is called once a task and returns ``kernel(slice) -> dict`` of
    new columns (name -> Arrow array or list).  Columns of ``schema`` that the
    kernel doesn't return pass through unchanged.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = start()
        for batch in batches:
            for piece in slices(batch, column, most):
                made = kernel(piece)
                arrays = [
                    _typed(made[f.name], f.type) if f.name in made else piece.column(piece.schema.get_field_index(f.name))
                    for f in target
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=target.names)
        del kernel
        pa.default_memory_pool().release_unused()  # workers live on and serve other tasks

    return df.mapInArrow(run, schema)


def _typed(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id's decimal text is a multiple of 5 (null: its text is empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
