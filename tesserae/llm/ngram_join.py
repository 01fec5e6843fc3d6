"""N-gram Jaccard join with MinHash banding and exact verification.

1. A text becomes its set of word shingles.  Texts with equal sets are copies;
   one row for each distinct set goes on.
2. Bands of MinHash values (:func:`choose_bands` picks their number and height for
   a target recall at the threshold) are shuffled on their hash.  Sets that meet
   in a band are candidates; buckets with the same members are taken once.
3. Members of a bucket get their full sets, and every candidate pair is verified
   in the first band in which it meets, so in one place only.  A large bucket is cut into
   blocks and each pair of blocks is a task of its own; nothing is dropped or capped.
   A block pair returns, for each member, its number of links and one edge to
   the least member that it is tied to there - never a row for each pair.
4. Components of those edges are the classes.

Defined cases: a text without words (null, empty, blank) has no shingles, links to nothing
and is a class of its own (with ``wordless_together``, as in :func:`one_of_each`, all such texts
are copies of each other and form one class); a text with fewer than five words has one shingle;
repeated rows are copies of each other, each with a row in the result; null keys are allowed,
and a class with only null keys has a null id; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tesserae.llm import bloom, common, components, shingles

THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 144
#: Members and shingles of a block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
MOST_BROADCAST = 1 << 20
_COLUMNS = 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the tallest bands that still reach the recall at the threshold with ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        met = threshold**rows
        bands = 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-met))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches that recall with so few hashes")
    return best


def band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int = 11) -> np.ndarray:
    mins = shingles.minhashes(sets, shingles.odd_factors(bands * rows, seed)).reshape(len(sets), bands, rows)
    out = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        out = shingles.mix(out + mins[:, :, r] + np.uint64(r + 1))
    return out


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def verify_block(sets: list[np.ndarray], bands: np.ndarray, band: int, weight: np.ndarray, left: np.ndarray, cross: bool, threshold: float):
    """Links of a block: per member the linked documents, the linked sets and the least linked-to index.

    ``left`` marks the members of the first block; with ``cross`` only pairs of one member of either block count.
    """
    g = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    meet = np.ones((g, g), bool) if not cross else left[:, None] != left[None, :]
    for j in range(band):
        meet &= bands[:, None, j] != bands[None, :, j]
    np.fill_diagonal(meet, False)
    meet &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
    use = meet.any(1)
    if not use.any():
        return np.zeros(g, np.int64), np.zeros(g, np.int64), np.arange(g)
    member = np.repeat(np.arange(g), [len(s) if u else 0 for s, u in zip(sets, use, strict=True)])
    every, column, times = np.unique(np.concatenate([s for s, u in zip(sets, use, strict=True) if u]), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    member, column = member[shared], column[shared]
    new = np.cumsum(times > 1) - 1
    column = new[column]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    common_n = np.zeros((g, g), np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        x = np.zeros((g, min(_COLUMNS, width - start)), np.float32)
        x[member[a:b], column[a:b] - start] = 1
        common_n += x @ x.T
    linked = meet & (common_n * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6) & (common_n > 0)
    label = np.arange(g)
    while True:
        reach = np.minimum(label, np.where(linked, label[None, :], g).min(1, initial=g))
        if (reach == label).all():
            break
        label = reach
    return (linked * weight[None, :]).sum(1), linked.sum(1), label


_SIGNED = StructType([StructField("set_key", BinaryType()), StructField("n_shingles", LongType()), StructField("bands", ArrayType(LongType()))])
_LINKS = StructType([StructField("set_key", BinaryType()), StructField("docs", LongType()), StructField("sets", LongType()), StructField("tied", BinaryType())])


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = shingles.WORDS, block: int = BLOCK, wordless_together: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: key, class_id (least key of the class), n_links (other documents at the threshold), n_copies (documents with its shingle set, with itself).

    With ``wordless_together`` the empty shingle set is a set like any other, equal to itself.
    """
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(key, text)

    def sign():
        def kernel(piece):
            sets = [shingles.shingle_set(t, words) for t in common.texts(piece, text)]
            full = [s for s in sets if len(s)]
            made = iter(band_hashes(full, bands, rows).view(np.int64).tolist() if full else [])
            return {"set_key": [set_key(s) if len(s) or wordless_together else None for s in sets], "n_shingles": [len(s) for s in sets], "bands": [next(made) if len(s) else None for s in sets]}

        return kernel

    signed = common.written(common.map_slices(docs, StructType([docs.schema[key], *_SIGNED]), text, sign), "ngram-signed")
    distinct = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    distinct = common.written(distinct, "ngram-sets")

    met = distinct.select("set_key", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    buckets = met.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("held"), F.bit_xor(F.xxhash64("set_key")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "set_key")).alias("s2")
    ).filter("n > 1")
    buckets = buckets.groupBy("s1", "s2", "n", "held").agg(F.min(F.struct("band", "hash")).alias("at")).select(
        "at.band", "at.hash", F.ceil(F.greatest(F.col("n") / block, F.col("held") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    members = common.written(met.select("set_key", "band", "hash").join(buckets, ["band", "hash"]), "ngram-members")

    # Texts are read again for the full sets: those of the least key of each set that is in a bucket.
    wanted = members.select("set_key").distinct().join(distinct.select("set_key", "rep"), "set_key").select(F.col("rep").alias("__rep"))
    wanted = common.written(wanted, "ngram-wanted")
    if (many := wanted.count()) <= most_broadcast:
        chosen = docs.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("__rep")), "left_semi")
    else:  # a bit table instead; the few rows that it lets in besides have no place in a bucket, or are there once already
        table = bloom.table_of(wanted.select(bloom.digest_of(F.col("__rep")).alias("d")), "d", bloom.bits_for(many))
        chosen = bloom.flagged(docs, bloom.digest_of(F.col(key)), table, "__wanted").filter("__wanted")

    def sets_of():
        def kernel(piece):
            sets = [shingles.shingle_set(t, words) for t in common.texts(piece, text)]
            return {"set_key": [set_key(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return kernel

    full = common.map_slices(chosen, StructType([StructField("set_key", BinaryType()), StructField("shingles", BinaryType())]), text, sets_of)
    full = full.join(distinct.select("set_key", "copies", "bands"), "set_key")
    own = F.pmod(F.xxhash64(F.lit(3), "set_key"), F.col("blocks")).cast("int")
    placed = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other"))
        .select("set_key", "band", "hash", "b1", "b2", "own")
    )
    ready = placed.join(full, "set_key").repartition("band", "hash", "b1", "b2").sortWithinPartitions("band", "hash", "b1", "b2")
    links = common.written(ready.mapInArrow(_verifier(threshold), _LINKS), "ngram-links")

    per_set = links.groupBy("set_key").agg(F.sum("docs").alias("docs"))
    label = components.stars(links.filter("set_key <> tied"), "set_key", "tied")
    joined = distinct.select("set_key", "rep", "copies").join(label, F.col("set_key") == F.col("node"), "left").join(per_set, "set_key", "left")
    joined = common.written(joined.select("set_key", "rep", F.col("copies").alias("n_copies"), F.coalesce("label", "set_key").alias("label"), F.coalesce("docs", F.lit(0)).alias("docs")), "ngram-labels")
    sets, rows_with = joined.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_copies"), F.lit(0))).first()
    ids = joined.groupBy("label").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("__members"))
    classes = common.join_skewed(joined, ids, "label", "__members", sets)
    classes = common.written(classes.select("set_key", "class_id", (F.col("docs") + F.col("n_copies") - 1).cast("bigint").alias("n_links"), "n_copies"), "ngram-classes")
    alone = signed.filter("set_key IS NULL").select(key, F.col(key).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    found = common.join_skewed(signed.filter("set_key IS NOT NULL").select(key, "set_key"), classes, "set_key", "n_copies", rows_with)
    return found.select(key, "class_id", "n_links", "n_copies").unionByName(alone)


def _verifier(threshold: float):
    """mapInArrow function over rows sorted by group: verifies one block pair after the other."""
    names = ["band", "hash", "b1", "b2"]

    def done(at, rows) -> pa.RecordBatch:
        rows = list({r["set_key"]: r for r in rows}.values())  # rows with one id and set twice
        rows.sort(key=lambda r: r["set_key"])
        band, _, b1, b2 = at
        found = verify_block(
            [np.frombuffer(r["shingles"], np.uint64) for r in rows],
            np.array([r["bands"] for r in rows], np.int64).reshape(len(rows), -1),
            band,
            np.array([r["copies"] for r in rows], np.int64),
            np.array([r["own"] == b1 for r in rows], bool),
            b1 != b2,
            threshold,
        )
        docs, sets, label = found
        keep = np.flatnonzero(sets)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i]["set_key"] for i in keep], pa.binary()),
                pa.array(docs[keep], pa.int64()),
                pa.array(sets[keep], pa.int64()),
                pa.array([rows[label[i]]["set_key"] for i in keep], pa.binary()),
            ],
            names=_LINKS.names,
        )

    def run(batches):
        at, held = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    now = tuple(row[n] for n in names)
                    if now != at and held:
                        yield done(at, held)
                        held = []
                    at = now
                    held.append(row)
        if held:
            yield done(at, held)

    return run


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", most_broadcast: int = MOST_BROADCAST, **options) -> DataFrame:
    """``docs`` with one row of every class: that with the least key, of equal keys the least hash of the text.

    Texts without words are one class. Rows with equal key and text are told apart by number, and one stays.
    """
    row = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("n"))
    numbered = common.written(docs.withColumn("__row", row), "ngram-docs")
    classes = similarity_classes(numbered, "__row", text, wordless_together=True, most_broadcast=most_broadcast, **options)
    gone = common.written(classes.filter("class_id <> __row").select("__row"), "ngram-gone")
    if gone.count() <= most_broadcast:
        gone = F.broadcast(gone)
    return numbered.join(gone, "__row", "left_anti").select(*docs.columns)
