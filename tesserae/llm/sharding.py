"""Sharding over fixed virtual slots (DataFrame functions only).

A record's id is hashed into one of :data:`SLOTS` virtual slots. A stored, versioned
table says of every slot to which shard it belongs and how many rows and bytes it holds
(summed per slot before the shuffle). Growing or rebalancing reads a version, edits single slots
and stores the next one; records never rehash.  The map has as many rows as there are slots,
whatever the size of the data, so it is the one thing that is broadcast.

Defined cases: a null id hashes as the empty text; equal ids share a slot; rows
of an empty table give an empty result; a null text has no bytes, so its size is
the fixed :data:`ROW_BYTES`; other input columns pass through, and an input column
named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common

SLOTS = 4096
ROW_BYTES = 8


def slot_of(id_column, slots: int = SLOTS):
    """Virtual slot of an id: its text's MD5, first 60 bits, modulo ``slots``."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt to the shards in turn. Columns version, vslot, shard."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard")
    )


_MAP = "vslot int, shard int, slot_rows bigint, slot_bytes bigint, version int"


def with_load(slot_map: DataFrame, load: DataFrame) -> DataFrame:
    """A map with each slot's rows and bytes (0 where it has none)."""
    return slot_map.select("version", "vslot", "shard").join(F.broadcast(load), "vslot", "left").fillna(0, ["slot_rows", "slot_bytes"])


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add one version of the map to the table at ``path`` (one folder a version; storing a version again replaces it)."""
    columns = [c.split()[0] for c in _MAP.split(", ")]
    slot_map.select(*columns).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, else the latest."""
    stored = spark.read.schema(_MAP).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def grown_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version for one more shard: each old shard gives up its last slots.

    Depends on the map alone, so ids and shard count decide where a row is.
    """
    total = F.count(F.lit(1)).over(Window.partitionBy("version"))
    place = F.row_number().over(Window.partitionBy("version", "shard").orderBy("vslot"))
    stays = place <= F.ceil(total / F.lit(shards + 1))
    return slot_map.select(
        (F.col("version") + 1).alias("version"), "vslot", F.when(stays, F.col("shard")).otherwise(F.lit(shards)).cast("int").alias("shard")
    )


def slot_bytes(rows: DataFrame, vslot: str = "vslot", size: str = "size") -> DataFrame:
    """Rows and bytes of each virtual slot: at most :data:`SLOTS` rows, summed before the shuffle."""
    return rows.groupBy(F.col(vslot).alias("vslot")).agg(F.count(F.lit(1)).alias("slot_rows"), F.sum(size).alias("slot_bytes"))


def rebalanced_map(slot_map: DataFrame, load: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """The next version, evened out by bytes.

    Slots of a shard above its share are handed, in slot order, to the shards
    that lack bytes: the overflow of all shards and the room of all shards are
    laid end to end on one line, and a slot goes where its overflow falls.
    Shards within ``tolerance`` of the mean keep all their slots.  Both inputs
    have one row a slot, so the windows here are small at any size of data.
    """
    w = Window.partitionBy("version", "shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("version")
    slot_map = slot_map.select("version", "vslot", "shard")
    m = slot_map.join(F.broadcast(load.select("vslot", "slot_bytes")), "vslot", "left").fillna(0, ["slot_bytes"])
    totals = m.groupBy("version", "shard").agg(F.sum("slot_bytes").alias("held")).withColumn("mean", F.avg("held").over(every))
    line = Window.partitionBy("version").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = totals.withColumn("room", F.greatest(F.col("mean") - F.col("held"), F.lit(0.0))).withColumn("room_end", F.sum("room").over(line))
    takers = room.filter("room > 0").select(F.col("version").alias("tv"), F.col("shard").alias("taker"), (F.col("room_end") - F.col("room")).alias("from"), F.col("room_end").alias("to"))
    m = m.join(F.broadcast(totals), ["version", "shard"]).withColumn("run", F.sum("slot_bytes").over(w))
    m = m.withColumn("goes", (F.col("held") > F.col("mean") * (1 + tolerance)) & (F.col("run") > F.col("mean")) & (F.col("slot_bytes") > 0))
    over = Window.partitionBy("version").orderBy("shard", "vslot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("at", F.sum(F.when(F.col("goes"), F.col("slot_bytes")).otherwise(0)).over(over) - F.col("slot_bytes") / 2)
    moved = m.filter("goes").join(
        F.broadcast(takers), (F.col("version") == F.col("tv")) & (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to")), "left"
    ).select("version", "vslot", "taker")
    return slot_map.join(F.broadcast(moved), ["version", "vslot"], "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("taker", "shard").cast("int").alias("shard")
    )


def assign(rows: DataFrame, slot_map: DataFrame, order: list[str], vslot: str = "vslot") -> DataFrame:
    """Add ``shard``, ``map_version`` and the gapless place ``slot`` (from 0) in that shard, by a map with ``slot_rows`` of these rows.

    Places are counted within each virtual slot and offset by the rows of the
    shard's earlier slots, so no task ever sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select(F.col("vslot").alias("__vslot"), "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(vslot).orderBy(*order)) - 1
    return (
        rows.drop("shard", "slot", "map_version").withColumn("__place", within)
        .join(F.broadcast(offsets), F.col(vslot) == F.col("__vslot"))
        .withColumn("slot", F.col("__offset") + F.col("__place"))
        .drop("__place", "__vslot", "__offset")
    )


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    The map is stored at ``path`` (a folder of its own in the shared one, if none is given): version 1 with each slot's rows and bytes, from which rows are
    placed, and version 2, edited from it for one more shard.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(
        "doc_id", (F.octet_length(data) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("vslot")
    )
    rows = common.written(rows, "shard-rows")
    path = path or common.new_path(spark, "shard-map")
    store_map(with_load(initial_map(spark, shards, slots), slot_bytes(rows)), path)
    first = load_map(spark, path, 1)
    store_map(with_load(grown_map(first, shards), first.select("vslot", "slot_rows", "slot_bytes")), path)
    placed = assign(rows, first, ["doc_id", "text_crc32", "size"])
    grown = load_map(spark, path, 2).select("vslot", F.col("shard").alias("grown_shard"))
    return placed.join(F.broadcast(grown), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "vslot", "map_version"
    )
