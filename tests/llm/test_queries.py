"""The registered queries over the small tables: columns, rows, and SQL where there is some."""

import duckdb
import pytest

pytest.importorskip("tesserae.llm")

from tesserae.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op2_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_media_jpeg": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4_ngram_join": "doc_id class_id n_links",
    "op5_packing": "doc_id n_tokens bucket batch place padding",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_quality": "doc_id held_out score predicted",
    "op9_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
}


def test_all_ten_are_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)} and set(COLUMNS) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/{'pages' if name.startswith('op7') else 'documents'}.parquet").count()
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, want.select(*columns).fetchall()))
