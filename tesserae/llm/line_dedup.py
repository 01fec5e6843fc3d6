"""Line dedup with two Bloom filters and exact confirmation.

1. One pass fills two bit tables: *once* (keys seen) and *twice* (keys that
   were already in *once*).  Tables of different tasks merge by bit: whatever
   is in two tasks' *once* tables joins *twice*.
2. A second pass sends on only the 128-bit hashes of keys that *twice* may
   hold, with their number of documents counted in the task; one shuffle sums
   them exactly.  False suspects fall out here.
3. A last pass drops the lines of confirmed keys.

The tables have a fixed size (:data:`MOST_BITS` at most).  When a corpus has
more keys than they tell apart, more keys become suspects and shuffle; the
result is the same.  Confirmed keys are broadcast only up to
:data:`MOST_BROADCAST` of them; beyond it they are joined to each document's
suspect lines by a shuffle.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with
A-Z in lower case.

Defined cases: a null text stays null and counts as one empty line, as does an
empty text; keys shorter than ``min_chars`` code points never count; each row is
a document of its own, also where rows or ids repeat; a line that stands twice in
one document counts once; input columns named like ``names`` (n_lines and n_dropped) are replaced; with
``keep_first_by`` a null is less than any value, and equal values are told apart by the row's number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tesserae.llm import common
from tesserae.llm.bloom import LEAST_BITS, MOST_BITS, PARTS, WIDE, has, positions, put

EDGE = b" \t\n\x0b\x0c\r"
MOST_BROADCAST = 1 << 20
#: Keys that a task counts before it passes them on.
HELD = 1 << 18


def line_keys(data: bytes) -> list[bytes]:
    """Keys of all lines of one document."""
    return [x.strip(EDGE).lower() for x in data.split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def key_hashes(data: bytes, min_chars: int) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for k in set(line_keys(data)) if _long_enough(k, min_chars)}


def fill(once: np.ndarray, twice: np.ndarray, per_document: list[set[bytes]], bits: int) -> None:
    """Enter the key hashes of some documents."""
    seen = Counter(h for s in per_document for h in s)
    if not seen:
        return
    at = positions(list(seen), bits)
    again = np.fromiter((n > 1 for n in seen.values()), bool, len(seen)) | has(once, at)
    put(once, at)
    put(twice, at[again])


def _merge(once: np.ndarray, twice: np.ndarray, other_once: np.ndarray, other_twice: np.ndarray) -> None:
    twice |= other_twice | (once & other_once)
    once |= other_once


_PARTS = StructType([StructField("task", IntegerType()), StructField("part", IntegerType()), StructField("once", BinaryType()), StructField("twice", BinaryType())])


def _part_rows(task: int, part_of: Iterator) -> Iterator[pa.RecordBatch]:
    for part, once, twice in part_of:
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], names=_PARTS.names)


def twice_table(docs: DataFrame, text: str, bits: int, min_chars: int) -> np.ndarray:
    """The merged *twice* table, ``bits`` / 8 bytes on the driver."""

    def build(batches):
        from pyspark import TaskContext

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for piece in common.slices(batch, text):
                fill(once, twice, [key_hashes(x or b"", min_chars) for x in common.raw(piece, text)], bits)
        step = len(once) // PARTS
        yield from _part_rows(TaskContext.get().partitionId(), ((i, once[i * step : (i + 1) * step], twice[i * step : (i + 1) * step]) for i in range(PARTS)))

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                other = [np.frombuffer(row[k], np.uint8) for k in ("once", "twice")]
                if row["part"] in held:
                    _merge(*held[row["part"]], *other)
                else:
                    held[row["part"]] = (other[0].copy(), other[1].copy())
        for part, (once, twice) in held.items():
            yield from _part_rows(0, iter([(part, once, twice)]))

    parts = docs.select(text).mapInArrow(build, _PARTS)
    if (tasks := docs.rdd.getNumPartitions()) > WIDE:  # by groups of tasks first, so that no task reads the tables of all tasks
        groups = math.isqrt(tasks)
        parts = parts.repartition(PARTS * groups, "part", F.col("task") % groups).mapInArrow(merge, _PARTS)
    parts = parts.repartition(PARTS, "part").mapInArrow(merge, _PARTS)
    table = np.zeros(bits // 8, np.uint8)
    step = len(table) // PARTS
    for row in parts.select("part", "twice").collect():  # bits / 8 bytes in all
        table[row["part"] * step : (row["part"] + 1) * step] |= np.frombuffer(bytes(row["twice"]), np.uint8)
    return table


def repeated_keys(docs: DataFrame, text: str = "text", min_docs: int = 2, min_chars: int = 1, bits: int | None = None) -> tuple[DataFrame, object, int]:
    """Hashes of the keys that at least ``min_docs`` documents hold, the broadcast *twice* table and its size."""
    spark = docs.sparkSession
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 1 << (docs.count() * 64 - 1).bit_length()))
    shared = spark.sparkContext.broadcast(twice_table(docs, text, bits, min_chars))

    def suspects(batches):
        held: Counter[bytes] = Counter()
        for batch in batches:
            for piece in common.slices(batch, text):
                own = [h for x in common.raw(piece, text) for h in key_hashes(x or b"", min_chars)]
                if own:
                    found = has(shared.value, positions(own, bits))
                    held.update(h for h, ok in zip(own, found, strict=True) if ok)
                if len(held) > HELD:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    def _counts(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])

    schema = StructType([StructField("key", BinaryType()), StructField("n", LongType())])
    found = docs.select(text).mapInArrow(suspects, schema).groupBy("key").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return common.written(found, "line-keys"), shared, bits


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first_by: str | None = None, bits: int | None = None, most_broadcast: int = MOST_BROADCAST, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and the numbers of all and of dropped lines under ``names``.

    Keys in at least ``min_docs`` documents lose all their lines, or, with
    ``keep_first_by`` (a column, unique by row), all but those of the document
    with its least value: there the key's first line stays.
    """
    keys, shared, bits = repeated_keys(docs, text, min_docs, min_chars, bits)
    few = keys.count() <= most_broadcast  # of a written table
    schema = common.replaced(docs.schema, StructField(text, StringType()), *(StructField(n, LongType()) for n in names))
    if few and keep_first_by is None:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in keys.select("key").collect()))

        def start():
            drop = known.value
            return lambda piece: _kept(common.raw(piece, text), lambda i, h, first: h in drop, text, min_chars, names)

        return common.map_slices(docs, schema, text, start)

    # Suspect lines of each document meet the confirmed keys by a shuffle; the row's number finds the document again.
    numbered = common.written(docs.withColumn("__row", F.monotonically_increasing_id()), "line-docs")
    own = StructType([StructField("__row", LongType()), StructField("__by", numbered.schema[keep_first_by].dataType if keep_first_by else LongType()), StructField("key", BinaryType())])

    def lines(batches):
        for batch in batches:
            for piece in common.slices(batch, text):
                rows = piece.column(piece.schema.get_field_index("__row")).to_pylist()
                by = piece.column(piece.schema.get_field_index("__by"))
                at, found = [], []
                for i, x in enumerate(common.raw(piece, text)):
                    own_keys = list(key_hashes(x or b"", min_chars))
                    if own_keys:
                        for h, ok in zip(own_keys, has(shared.value, positions(own_keys, bits)), strict=True):
                            if ok:
                                at.append(i)
                                found.append(h)
                yield pa.RecordBatch.from_arrays([pa.array([rows[i] for i in at], pa.int64()), by.take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], names=own.names)

    by = F.col(keep_first_by) if keep_first_by else F.col("__row")
    hits = numbered.select("__row", by.alias("__by"), text).mapInArrow(lines, own).join(keys.select("key"), "key")
    if keep_first_by:
        first = hits.groupBy("key").agg(F.min(F.struct("__by", "__row"))["__row"].alias("__first"))
        hits = hits.join(first, "key").withColumn("first", F.col("__row") == F.col("__first"))
    else:
        hits = hits.withColumn("first", F.lit(False))
    per_row = hits.groupBy("__row").agg(F.collect_list("key").alias("__drop"), F.collect_list("first").alias("__is_first"))
    joined = numbered.join(per_row, "__row", "left")

    def start_joined():
        def kernel(piece):
            drop = piece.column(piece.schema.get_field_index("__drop")).to_pylist()
            first = piece.column(piece.schema.get_field_index("__is_first")).to_pylist()
            known = [dict(zip(a or (), b or (), strict=True)) for a, b in zip(drop, first, strict=True)]

            def gone(i, h, seen):
                return h in known[i] and not (known[i][h] and h not in seen)

            return _kept(common.raw(piece, text), gone, text, min_chars, names)

        return kernel

    return common.map_slices(joined, schema, text, start_joined)


def _kept(documents: list[bytes | None], gone, text: str, min_chars: int, names: tuple[str, str]) -> dict:
    kept, n_lines, n_dropped = [], [], []
    for i, data in enumerate(documents):
        lines = (data or b"").split(b"\n")
        stay, seen = [], set()
        for line in lines:
            key = line.strip(EDGE).lower()
            if _long_enough(key, min_chars):
                h = xxhash.xxh3_128_digest(key)
                if gone(i, h, seen):
                    continue
                seen.add(h)
            stay.append(line)
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
        kept.append(None if data is None else b"\n".join(stay).decode())
    return {text: kept, names[0]: n_lines, names[1]: n_dropped}
