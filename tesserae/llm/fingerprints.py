"""Document fingerprints: one-permutation MinHash with optimal densification.

Every shingle is hashed once; the hash picks one of ``bins`` bins and the least
value in a bin is kept.  An empty bin borrows from a bin that a 2-universal
hash of (bin, attempt) names, trying again until it meets a full one (without a limit), so that
which bin lends is the same for any two documents.  Of each value the ``bits``
lowest bits are stored, packed; the share of equal values by
chance, 2^-bits, is taken out of the estimate.

Defined cases: a text without words has the fingerprint ``-``; its likeness is 1 to
another such text and 0 to any other text; a text with fewer than five words has one shingle;
null texts are empty; equal texts have equal fingerprints; doc_id may be of any type with an order; in the edited
table rows are ordered by descending doc_id (nulls last), ties by the SHA-256 of their text, so rows of one id (or without
one) spread over ranges as well; rows with equal id and text stay together; a table of one row is its own next.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tesserae.llm import common, shingles

BINS = 256
BITS = 8
KEPT_ATTEMPTS = 1 << 12
#: Keys sampled for each range of the edited table.
SAMPLED = 100
EMPTY = "-"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


_known: dict[int, np.ndarray] = {}


def lenders(bins: int, first: int, last: int, seed: int = 29) -> np.ndarray:
    """Bin that an empty bin asks at the attempts ``first`` to ``last`` - 1, from 1 on: shape (attempts, bins)."""
    a, b = shingles.odd_factors(2, seed)
    i = np.arange(bins, dtype=np.uint64)[None, :]
    t = np.arange(first, last, dtype=np.uint64)[:, None]
    return (shingles.mix(i * a + t * b) % np.uint64(bins)).astype(np.int32)


def _attempts(bins: int):
    """Blocks of attempts without end; those up to :data:`KEPT_ATTEMPTS` are kept for the next text."""
    if bins not in _known:
        _known[bins] = lenders(bins, 1, KEPT_ATTEMPTS + 1)
    start, size = 0, 16
    while True:
        yield _known[bins][start : start + size] if start + size <= KEPT_ATTEMPTS else lenders(bins, start + 1, start + size + 1)
        start, size = start + size, start + size


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """Values of all bins, densified; None without hashes."""
    if len(hashes) == 0:
        return None
    h = shingles.mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    out = np.full(bins, _NONE)
    np.minimum.at(out, (h % np.uint64(bins)).astype(np.int64), h >> np.uint64(10))
    full = out != _NONE
    if full.all():
        return out
    todo, made = np.flatnonzero(~full), out.copy()
    for ask in _attempts(bins):
        own = ask[:, todo]
        met = full[own]
        found = met.any(0)
        lender = own[met.argmax(0), np.arange(len(todo))][found]
        made[todo[found]] = shingles.mix(out[lender] + np.uint64(1))
        todo = todo[~found]
        if not len(todo):
            return made


def packed(values: np.ndarray | None, bits: int = BITS) -> bytes | None:
    """The ``bits`` lowest bits of each value."""
    if values is None:
        return None
    if bits == 8:
        return (values & np.uint64(255)).astype(np.uint8).tobytes()
    cut = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(cut).tobytes()


def unpacked(data: bytes, bits: int = BITS) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(data, np.uint8)
    cut = np.unpackbits(np.frombuffer(data, np.uint8))
    cut = cut[: len(cut) // bits * bits].reshape(-1, bits)
    return (cut.astype(np.int64) << np.arange(bits)).sum(1)


def likeness(a: bytes | None, b: bytes | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity, corrected for values that agree by chance."""
    if a is None or b is None:
        return float(a is None and b is None)
    same = float((unpacked(a, bits) == unpacked(b, bits)).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def fingerprint(text: str) -> bytes | None:
    return packed(sketch(shingles.shingle_hashes(shingles.word_hashes(text.split()))))


def shown(data: bytes | None) -> str:
    return EMPTY if data is None else base64.b64encode(data).decode()


def with_fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the packed fingerprint of each text as base64."""
    schema = common.replaced(docs.schema, StructField(to, StringType()))
    return common.map_slices(docs, schema, text, lambda: lambda piece: {to: [shown(fingerprint(t)) for t in common.texts(piece, text)]})


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = [
    StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()),
    StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
]


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the contract of the query op9).

    The next document comes from one shuffle into ranges of (doc_id, hash of the text). The ranges' bounds
    are taken from a sample of those keys (:data:`SAMPLED` for each range), and the one document that the next higher
    range needs from a range - its largest - is sent there as well, so no
    window runs over the whole table.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    # Ascending, this is the table's order from its end: nulls first, equal ids by descending SHA-256 (its first 60 bits).
    tie = -F.conv(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("bigint")
    docs = docs.select("doc_id", "text", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", tie.alias("tie")).alias("key"))
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = []
    if ranges > 1 and (rows := docs.count()):
        draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, ranges * SAMPLED / rows)))
        drawn = [r["key"] for r in docs.select("key").filter(draw).distinct().orderBy("key").collect()]  # ranges * SAMPLED, more or less
        cuts = [drawn[i] for i in sorted({len(drawn) * j // ranges for j in range(1, ranges)})] if drawn else []
    literal = lambda k: F.struct(F.lit(k["known"]).alias("known"), F.lit(k["doc_id"]).cast(kind).alias("doc_id"), F.lit(k["tie"]).cast("bigint").alias("tie"))
    placed = docs.withColumn("part", _range_of(F.col("key"), [literal(k) for k in cuts], docs.schema["key"].dataType.simpleString()).cast("int"))
    # Of each range its largest key, and the range above it (the lowest one after the highest); as many rows as ranges.
    tops = placed.groupBy("part").agg(F.max("key").alias("top"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(F.col("part").alias("__part"), "top", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(every)).alias("above"))
    step = placed.join(F.broadcast(tops), F.col("part") == F.col("__part"))
    home = F.struct(F.col("part").alias("to"), F.lit(False).alias("guest"))
    step = step.withColumn("c", F.explode(F.when(F.col("key") == F.col("top"), F.array(home, F.struct(F.col("above").alias("to"), F.lit(True).alias("guest")))).otherwise(F.array(home))))
    # Of tied border rows any may be the guest: they have one text.
    ready = step.select("doc_id", "text", "key", "c.to", "c.guest").repartitionById(len(cuts) + 1, "to")
    ready = ready.sortWithinPartitions(F.col("to"), F.col("guest").desc(), F.col("key").desc()).select("doc_id", "text", "to", "guest")
    schema = StructType([StructField("doc_id", kind), *_RESULT])
    return ready.mapInArrow(_edit_rows(schema), schema)


def _range_of(column, cuts: list, kind: str):
    """Number of cuts (Columns of one type, ascending) below the value: first among every so many cuts, then in between."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    below = lambda a: F.size(F.filter(a, lambda c: c < column))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    full = below(F.array(*[p[-1] for p in parts if len(p) == step]))
    if len(parts[-1]) == step:
        parts.append([])
    return full * step + below(F.element_at(F.array(*[F.array(*p).cast(f"array<{kind}>") for p in parts]), full + 1))


def _edit_rows(schema: StructType):
    """mapInArrow function over rows by range: a guest first (the document after the range's last), then the range in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        part = guest = None

        def row(now, following):
            doc_id, text, own = now
            other_text, other = following
            new = edited(text, other_text)
            mine, theirs = own, fingerprint(new)
            return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(mine), shown(theirs), likeness(mine, theirs), likeness(mine, other)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], names=target.names)

        waiting = None
        out = []
        for batch in batches:
            for piece in common.slices(batch, "text"):
                to, is_guest, doc_ids = (piece.column(piece.schema.get_field_index(n)).to_pylist() for n in ("to", "guest", "doc_id"))
                for p, g, d, t in zip(to, is_guest, doc_ids, common.texts(piece, "text"), strict=True):
                    if p != part:
                        if waiting is not None:
                            out.append(row(waiting, guest))
                        part, guest, waiting = p, None, None
                    if g:
                        guest = guest or (t, fingerprint(t))
                        continue
                    own = fingerprint(t)
                    if waiting is not None:
                        out.append(row(waiting, (t, own)))
                    waiting = (d, t, own)
                if out:
                    yield batch_of(out)
                    out = []
        if waiting is not None:
            out.append(row(waiting, guest))
        if out:
            yield batch_of(out)

    return run
