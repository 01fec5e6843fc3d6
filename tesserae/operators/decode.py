"""Codeword lookup as a similarity join.

Two words within ``h`` bits agree in at least one of ``h + 1`` (here four) chunks,
so an equi-join on (chunk number, chunk value) finds every candidate and a popcount
confirms it.  The index has four rows a code: its size comes from the families, and it is broadcast
only below :data:`MOST_INDEX` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.config import FamilyError
from tesserae.families import Family, code_table

CHUNKS = 4
MOST_CODES = 65534
MOST_ERRORS = 3
MOST_INDEX = 1 << 18


def rotate90(word: Column, bits: int) -> Column:
    size, odd = (bits - 1, 1) if bits % 4 == 1 else (bits, 0)
    ring, quarter = F.shiftright(word, odd), size // 4
    turned = F.shiftleft(ring, quarter).bitwiseOR(F.shiftright(ring, size - quarter)).bitwiseAND(F.lit((1 << size) - 1))
    return F.shiftleft(turned, odd).bitwiseOR(word.bitwiseAND(F.lit(odd))).cast("bigint")


def rotations(words: DataFrame, word: str, bits: int) -> DataFrame:
    """One row for each of the four rotations: columns rotation and turned."""
    steps = [F.col(word)]
    for _ in range(3):
        steps.append(rotate90(steps[-1], bits))
    return words.select("*", F.posexplode(F.array(*steps)).alias("rotation", "turned"))


def chunk_width(bits: int) -> int:
    return -(-bits // CHUNKS)


def chunks(words: DataFrame, word: str, bits: int) -> DataFrame:
    """One row for each chunk: columns chunk and value."""
    width = chunk_width(bits)
    parts = [F.shiftright(F.col(word), i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(CHUNKS)]
    return words.select("*", F.posexplode(F.array(*parts)).alias("chunk", "value"))


def index(spark, fam: Family, errors: int = 2) -> DataFrame:
    """family, id, code, chunk, value."""
    if not 0 <= errors <= MOST_ERRORS:
        raise FamilyError(f"from 0 to {MOST_ERRORS} bits can be corrected")
    if len(fam.need_codes()) > MOST_CODES:
        raise FamilyError(f"more than {MOST_CODES} codes")
    return chunks(code_table(spark, [fam]), "code", len(fam.bits))


def index_stats(table: DataFrame) -> DataFrame:
    """Least, mean and largest number of codes under a chunk value in use."""
    held = table.groupBy("family", "chunk", "value").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("family").agg(F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


def lookup(words: DataFrame, fam: Family, word: str = "word", key: str = "o_orderkey", errors: int = 2) -> DataFrame:
    """First match of each word: by rotation, then chunk, then id. Columns key, family, id, hamming, rotation."""
    bits = len(fam.bits)
    table = index(words.sparkSession, fam, errors)
    if len(fam.need_codes()) * CHUNKS <= MOST_INDEX:
        table = F.broadcast(table)
    turned = chunks(rotations(words.select(key, word), word, bits), "turned", bits)
    hits = turned.join(table, ["chunk", "value"]).withColumn("hamming", F.bit_count(F.col("turned").bitwiseXOR(F.col("code")))).filter(F.col("hamming") <= errors)
    # The least struct is the first match; this aggregates before the shuffle where a window would not.
    best = hits.groupBy(key).agg(F.min(F.struct("rotation", "chunk", "id", "hamming", "family")).alias("m"))
    return best.select(key, "m.family", "m.id", "m.hamming", "m.rotation")
