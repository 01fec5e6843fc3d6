"""Packing into padded batches with optimal length buckets.

The histogram of lengths over all documents is the input of a dynamic
programme that chooses the bucket boundaries with the least padding, over all distinct lengths: there are
no more of them than the longest document has tokens, nor than the square root of twice all tokens.
Of the cuts before a length the best one is found as the lowest of lines in a convex hull, so the programme takes
time in proportion to the distinct lengths times the buckets.  Inside a bucket every document is padded
to the boundary, and a batch holds as many as fit the token budget, or one.

Places inside a bucket are counted in lanes (by hash, as many as the number of documents asks for) and offset by the rows of
earlier lanes, so a bucket with a third of all documents is never sorted as one.

Defined cases: a null or empty text has no tokens and takes one padding token; a
document longer than the budget is a batch of its own; equal rows take places of
their own; an empty table has no buckets and gives no rows; input columns named
like a result are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import common

#: Documents of a lane when all are alike, and bounds of the lanes of a bucket.
LANE_DOCS = 1 << 16
LEAST_LANES, MOST_LANES = 64, 1 << 15


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise padded tokens.

    ``lengths`` ascending and distinct.  cost[j] over the first j lengths with k
    buckets is min over i < j of cost[i] + lengths[j-1] * (documents i..j-1).  For a fixed k that is the least
    of the lines cost[i] - x * total[i] at x = lengths[j-1]; their slopes fall and x rises, so the lines
    that can still be least form a queue.  Whole numbers throughout.
    """
    n = len(lengths)
    if n == 0:
        return []
    at = [int(x) for x in lengths]
    total = [0, *(int(x) for x in np.cumsum(counts))]
    best: list[int | None] = [0] + [None] * n
    cuts = []
    for _ in range(min(buckets, n)):
        made, cut = [0] + [0] * n, np.zeros(n + 1, np.int32)
        queue: list[tuple[int, int, int]] = []  # (documents before, cost, index), lowest line first
        head = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, base = total[j - 1], best[j - 1]
                while len(queue) - head > 1:  # the last line is never lowest between its neighbours
                    (s1, b1, _), (s2, b2, _) = queue[-2], queue[-1]
                    if (base - b1) * (s2 - s1) > (b2 - b1) * (slope - s1):
                        break
                    queue.pop()
                queue.append((slope, base, j - 1))
            x = at[j - 1]
            while len(queue) - head > 1 and queue[head + 1][1] - x * queue[head + 1][0] < queue[head][1] - x * queue[head][0]:
                head += 1
            slope, base, cut[j] = queue[head]
            made[j] = base + x * (total[j] - slope)
        best = made
        cuts.append(cut)
    found, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        found.append(at[j - 1])
        j = int(cut[j])
    return sorted(set(found))


def pack(counted: DataFrame, length: str = "n_tokens", buckets: int = 16, budget: int = 65536, key: str = "doc_id") -> DataFrame:
    """``counted`` with bucket, bucket_length, batch (in the bucket), place (in the batch), batch_docs and padding.

    ``counted`` must not change between reads (pass a written table).
    """
    spark = counted.sparkSession
    rows = counted.drop("bucket", "bucket_length", "batch", "place", "padding").withColumn("__len", F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(1)).cast("bigint"))
    histogram = rows.groupBy("__len").agg(F.count(F.lit(1)).alias("n")).orderBy("__len").toArrow()  # two numbers for each distinct length
    lengths, counts = (histogram.column(i).to_numpy() for i in range(2))
    bounds = boundaries(lengths, counts, buckets)
    lanes_of = max(LEAST_LANES, min(MOST_LANES, int(counts.sum()) // LANE_DOCS))
    if not bounds:
        bounds = [1]
    table = spark.createDataFrame([(i, b, max(1, budget // b)) for i, b in enumerate(bounds)], "bucket int, bucket_length bigint, capacity bigint")
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("__len") <= bounds[i], i).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("__lane", F.pmod(F.xxhash64(key, length), F.lit(lanes_of)).cast("int"))
    lanes = rows.groupBy("bucket", "__lane").agg(F.count(F.lit(1)).alias("n"))  # at most buckets x MOST_LANES rows
    before = Window.partitionBy("bucket").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("bucket", "__lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("bucket", "__lane").orderBy(key, length)) - 1
    place = F.col("__before") + F.col("__within")
    return (
        rows.withColumn("__within", within)
        .join(F.broadcast(lanes), ["bucket", "__lane"])
        .join(F.broadcast(table), "bucket")
        .withColumn("batch", F.floor(place / F.col("capacity")).cast("bigint"))
        .withColumn("place", (place % F.col("capacity")).cast("bigint"))
        .withColumn("padding", (F.col("bucket_length") - F.coalesce(F.col(length), F.lit(0))).cast("bigint"))
        .drop("__len", "__lane", "__within", "__before", "capacity")
    )


def pack_documents(docs: DataFrame, model_file, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, place, padding of each document."""
    from tesserae.llm import sentencepiece_codec

    counted = sentencepiece_codec.token_counts(docs.select("doc_id", "text"), model_file, drop_text=True)
    return pack(common.written(counted, "pack-lengths"), buckets=buckets, budget=budget).select("doc_id", "n_tokens", "bucket", "bucket_length", "batch", "place", "padding")
