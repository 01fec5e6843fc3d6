"""The pipeline's stages on the small documents, each against plain Python on its own input."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("tesserae.llm")

from tests.llm.test_near import shingle_sets  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen[name] = (docs.toPandas(), out.toPandas())
        docs = out
    before, after = seen["language_id"]
    assert len(after) >= 0.99 * len(before)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    before, after = seen["quality"]
    good = before[before.doc_id.map(labels) == 1]
    assert good.doc_id.isin(after.doc_id).mean() > 0.97

    before, after = seen["line_dedup"]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    shared = Counter(k for t in before.text for k in {key(x) for x in t.split("\n")})
    want = {d: "\n".join(x for x in t.split("\n") if not key(x) or shared[key(x)] < 10) for d, t in zip(before.doc_id, before.text, strict=True)}
    assert dict(zip(after.doc_id, after.text, strict=True)) == want
    assert (after.n_chars == after.text.str.len()).all()

    before, after = seen["ngram_join"]
    texts = before.text.tolist()
    sets = shingle_sets(texts)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
    of = dict(zip(before.doc_id, label, strict=True))
    assert sorted(of[d] for d in after.doc_id) == sorted(set(label))

    before, after = seen["packing"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    assert after.duplicated(["bucket", "batch", "place"]).sum() == 0
    assert (after.padding == after.bucket_length - after.n_tokens).all() and (after.padding >= 0).all()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


ODD = "doc_id bigint, text string, lang string, source string, n_chars int, n_lines string, n_dropped string, score string, predicted string, rejected string, lang_pred string, class_id string, bucket string, n_tokens string, word string"


def _odd_rows():
    plain = ["the cat sat on the mat and looked at the moon over the hill", "der hund lief durch den wald und sah den mond am himmel stehen", "a short line", "eine kurze zeile"]
    rows = []
    for i in range(60):
        text = plain[i % 4] + f" number {i % 9}"
        rows.append((i, text, "en" if i % 2 == 0 else "de", "web", len(text), *["clash"] * 9, None))
    long = " ".join(f"word{j}" for j in range(60_000))
    rows += [(100, None, None, None, None, *["clash"] * 9, "x"), (101, "", "en", "web", 0, *["clash"] * 9, "x"), (102, long, "en", "web", len(long), *["clash"] * 9, "x")]
    rows += [(None, plain[0] + " and no id", "en", None, 0, *[None] * 9, None), rows[5], rows[5]]
    return rows


def test_stages_with_odd_rows_and_clashing_names(spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    import os
    import tempfile

    sf = tempfile.mkdtemp()
    labels.write.parquet(os.path.join(sf, "labels.parquet"))
    docs = spark.createDataFrame(_odd_rows(), ODD).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert len(got) <= docs.count()
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert {r["n_lines"] for r in got} | {r["score"] for r in got} <= {"clash", None}
            if name != "line_dedup":  # rows pass through unchanged
                left = [tuple(r) for r in docs.collect()]
                for r in got:
                    left.remove(tuple(r))
        if name == "ngram_join":
            texts = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got)
            assert len(texts) == len(set(texts)) and (True, 102) in texts


def test_survivor_is_the_least_id_whatever_the_partitions(spark):
    rows = [(9 - i, "one two three four five six seven", "en", "w", 1) for i in range(9)] + [(50, "other words stand here now ok", "en", "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    for parts in (1, 4, 7):
        assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs.repartition(parts), SF).collect()) == [1, 50]
