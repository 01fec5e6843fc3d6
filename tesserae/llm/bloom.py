"""Bit tables over 128-bit digests: probing, filling, and building one over a table of digests."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

PROBES = 2
PARTS = 8
#: Tasks whose tables are merged in one step.
WIDE = 256
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Bit numbers of each digest: shape (digests, PROBES). ``bits`` is a power of two."""
    words = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return np.stack([(words[:, i] >> np.uint64(5)) & np.uint64(bits - 1) for i in range(PROBES)], 1).astype(np.int64)


def has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(1)


def put(table: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(table, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def bits_for(keys: int) -> int:
    """16 bits a key, a power of two between the bounds. Beyond the upper one more keys seem known; none is missed."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, keys * 16 - 1).bit_length()))


def digest_of(column):
    """128-bit digest of a value of any type, as a Column."""
    return F.unhex(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")))


_PARTS = StructType([StructField("task", IntegerType()), StructField("part", IntegerType()), StructField("bits", BinaryType())])


def table_of(digests: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bit table of all digests in a column: bits / 8 bytes on the driver."""

    def rows(task, parts):
        for part, own in parts:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=_PARTS.names)

    def build(batches):
        from pyspark import TaskContext

        table, any_row = np.zeros(bits // 8, np.uint8), False
        for batch in batches:
            if batch.num_rows:
                put(table, positions(batch.column(0).to_pylist(), bits))
                any_row = True
        if any_row:
            yield from rows(TaskContext.get().partitionId(), enumerate(np.split(table, PARTS)))

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["bits"], np.uint8)
                held[row["part"]] = held[row["part"]] | own if row["part"] in held else own.copy()
        yield from rows(0, held.items())

    parts = digests.select(column).filter(F.col(column).isNotNull()).mapInArrow(build, _PARTS)
    if (tasks := digests.rdd.getNumPartitions()) > WIDE:  # by groups of tasks first, so that no task reads the tables of all tasks
        groups = math.isqrt(tasks)
        parts = parts.repartition(PARTS * groups, "part", F.col("task") % groups).mapInArrow(merge, _PARTS)
    table = np.zeros((PARTS, bits // 8 // PARTS), np.uint8)
    for row in parts.repartition(PARTS, "part").mapInArrow(merge, _PARTS).select("part", "bits").collect():
        table[row["part"]] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return table.ravel()


def flagged(rows: DataFrame, digest, table: np.ndarray, to: str) -> DataFrame:
    """``rows`` with a boolean ``to``: whether the table may hold the digest (a Column of 16 bytes; null: no)."""
    shared, bits = rows.sparkSession.sparkContext.broadcast(table), len(table) * 8
    given = rows.withColumn(to, digest)
    schema = StructType([f if f.name != to else StructField(to, IntegerType()) for f in given.schema.fields])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(to)
            column = batch.column(at).to_pylist()
            known = [i for i, d in enumerate(column) if d is not None]
            flags = np.zeros(len(column), np.int32)
            if known:
                flags[known] = has(shared.value, positions([column[i] for i in known], bits))
            yield batch.set_column(at, to, pa.array(flags))

    return given.mapInArrow(run, schema).withColumn(to, F.col(to) == 1)
