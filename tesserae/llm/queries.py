"""The queries op1_ to op10_ over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def piece_model() -> str:
    """Where the tokenizer file is; asked on the executor that loads it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import line_dedup

    kept = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import sentencepiece_codec

    return sentencepiece_codec.round_trip(_documents(spark, sf_dir), piece_model)


def op3_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import media_jpeg

    return media_jpeg.stored_texts(_documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import ngram_join

    return ngram_join.similarity_classes(_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import packing

    return packing.pack_documents(_documents(spark, sf_dir), piece_model)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import lang_id

    return lang_id.identify(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import warc

    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import quality

    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import fingerprints

    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import sharding

    return sharding.shard_documents(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(list_zip(l, range(1, len(l) + 1))) AS z
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, z[1] AS line, z[2] AS pos,
         translate(trim(z[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), gone AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN gone g USING (key) GROUP BY doc_id
"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS data, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
five AS (
  SELECT page_id, h, first, strlen(data) AS n,
         list_transform(range(32), lambda i: (
           ((('0x' || substr(h || '00', 2 * ((5 * i) // 8)::INT + 1, 4))::BIGINT) >> (11 - (5 * i) % 8)::INT) & 31)) AS d
  FROM p JOIN g USING (h)
)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(d, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM five
"""


# CRC-32 byte by byte over the table of its polynomial; then slots, shards and places as windows.
_SHARD_SQL = """
WITH RECURSIVE tab(i, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 AS n, list_transform(range(len(h) // 2), lambda j:
  (16 * (strpos('0123456789ABCDEF', h[2 * j + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * j + 2]) - 1)::BIGINT) AS bytes FROM d),
r AS (SELECT doc_id, (n + 8)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 4096)::INT AS vslot FROM b, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, vslot % 24 AS shard,
  row_number() OVER (PARTITION BY vslot % 24 ORDER BY vslot, doc_id, text_crc32, size) - 1 AS slot,
  CASE WHEN vslot // 24 + 1 <= ceil(4096 / 25.0) THEN vslot % 24 ELSE 24 END AS grown_shard, vslot, 1 AS map_version
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINE_SQL, "op7_warc": _WARC_SQL, "op10_sharding": _SHARD_SQL}
