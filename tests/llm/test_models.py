"""Language ID and the quality classifier: held-out accuracy and defined cases."""

import numpy as np
import pytest

pytest.importorskip("tesserae.llm")
from pyspark.sql import functions as F  # noqa: E402

from tesserae.llm import lang_id, quality  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98
    assert got.score.between(0, 1).all()
    assert lang_id.known_language(docs).count() > 0.99 * docs.count()


def test_language_ignores_ids_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = lang_id.train(docs)
    a = lang_id.predict(docs.select("doc_id", "text"), model).toPandas().set_index("doc_id")
    b = lang_id.predict(docs.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit(5).alias("score")), model).toPandas()
    b = b.set_index(-b.doc_id).loc[a.index]
    assert (a.lang_pred == b.lang_pred).all() and np.allclose(a.score, b.score)


def test_language_cases(spark):
    docs = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)], "doc_id bigint, text string, lang string, rejected string")
    model = lang_id.train(docs)
    odd = [None, "", "123 %%", "\n", "the " * 50_000, "hund"]
    got = [r for r in lang_id.predict(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"), model).orderBy("doc_id").collect()]
    assert [r["lang_pred"] for r in got] == ["und"] * 4 + ["en", "de"]
    assert [r["rejected"] for r in got][:5] == [True] * 4 + [False]
    none = lang_id.train(docs.limit(0))
    assert lang_id.predict(docs.select("doc_id", "text"), none).filter("lang_pred <> 'und'").count() == 0
    one = lang_id.train(docs.filter("lang = 'en'"))
    assert lang_id.predict(docs.select("doc_id", "text"), one).filter("lang_pred <> 'en'").count() == 0
    assert lang_id.predict(docs.limit(0), model).collect() == []


def test_word_scores_don_t_hang_on_neighbours():
    words = ["aé", "b", "ccc", "b", "longer", "x"]
    bucket, owner = lang_id.word_features(words)
    for i, w in enumerate(words):
        own, _ = lang_id.word_features([w])
        assert sorted(bucket[owner == i]) == sorted(own)


def test_letters_are_letters():
    assert lang_id.words_of("x² ½ Ⅷ ٣ 12_a É日") == ["x", "a", "é日"]


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.predicted == got.quality).mean() > 0.98
    assert (got.predicted[got.quality == 1]).mean() > 0.995


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, "plain words stand here"), (2, None), (3, ""), (None, "plain words stand here"), (4, "!!!! " * 9000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 5 and got[1]["score"] == got[None]["score"] and got[2]["score"] == got[3]["score"]
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_class_prior_is_estimated():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.7, 0.9):
        pos = rng.normal(1.5, 1, (2000, 4))
        unl = np.concatenate([rng.normal(1.5, 1, (int(4000 * share), 4)), rng.normal(-1.5, 1, (4000 - int(4000 * share), 4))])
        assert abs(quality.class_prior(pos, unl, rng) - share) < 0.08


def test_language_scores_equal_plain_python(spark):
    """Scores of whole texts again, one feature at a time, from the trained model's numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_id.train(docs.filter("doc_id % 3 > 0"))
    mask = (1 << 64) - 1
    mixer = int(lang_id._MIX)

    def buckets(word):
        points = [ord(c) for c in f"<{word}>"]
        for start in range(len(points)):
            h = 0
            for n in range(1, 5):
                if start + n > len(points):
                    break
                h = ((h ^ ((points[start + n - 1] * mixer + n) & mask)) * 0xBF58476D1CE4E5B9) & mask
                h ^= h >> 31
                if n > 1:
                    yield (h >> 40) % lang_id.BUCKETS
        whole = sum((((p + ((len(points) - i) << 21)) * mixer) & mask) ^ (p << 7) for i, p in enumerate(points)) & mask
        yield (whole * 0x94D049BB133111EB & mask) >> 40 & (lang_id.BUCKETS - 1)

    got = {r["doc_id"]: r for r in lang_id.predict(docs.select("doc_id", "text"), model).collect()}
    for r in docs.orderBy(F.length("text")).limit(120).collect():
        words, word = [], ""
        for c in (r["text"] or "").lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                words, word = [*words, word], ""
        every = [b for w in words for b in buckets(w)]
        if not every:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        z = [(sum(float(model.table[b, k]) for b in every) / len(every) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
        p = [np.exp(x - max(z)) for x in z]
        best = int(np.argmax(z))
        assert got[r["doc_id"]]["lang_pred"] == model.languages[best]
        assert abs(got[r["doc_id"]]["score"] - p[best] / sum(p)) < 1e-6


def test_three_hundred_languages_are_learnt(spark):
    rows = [(i, " ".join(f"{'abcdefghijklmnopqrst'[g % 20]}{'vwxyz'[g // 20 % 5]}{'aeiou'[g // 100]}{c}" for c in "klmnoprst"), f"l{g:03}") for i, g in enumerate(list(range(300)) * 6)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 300


def test_a_language_of_long_texts_is_learnt(spark):
    rows = [(i, "the cat and the dog were here " * 3, "en") for i in range(40)] + [(100 + i, "der hund und die katze waren dort " * 800, "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = lang_id.predict(docs, lang_id.train(docs)).select("lang", "lang_pred").distinct().collect()
    assert sorted(map(tuple, got)) == [("de", "de"), ("en", "en")]


def test_quality_scores_equal_plain_python(spark):
    """Scores again from the trained model's numbers, with features counted one by one."""
    import unicodedata
    from collections import Counter

    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels)

    def kind(c):
        if c == "\n":
            return 4
        if ord(c) > 0xFFFF:
            c = "\uffff"
        k = unicodedata.category(c)
        return 0 if k in ("Ll", "Lo", "Lm", "Mn", "Mc") else 1 if k in ("Lu", "Lt") else 2 if k[0] == "N" else 3 if k[0] in "ZC" else 5 + ord(c) % 15

    f = [int(x) for x in quality._FACTORS]
    rows = docs.select("doc_id", "text").orderBy(F.length("text")).limit(60).collect()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    for r in rows:
        text = r["text"] or ""
        words, lines = text.split(), text.split("\n")
        x = np.zeros(quality.WIDTH)
        for (a, b), n in Counter((kind(a), kind(b)) for a, b in zip(text, text[1:])).items():
            x[a * 20 + b] = (n / max(1, len(text) - 1)) ** 0.5
        for b, n in Counter((xxhash.xxh3_64_intdigest(w) >> 40) % 256 for w in words).items():
            x[400 + b] = (n / len(words)) ** 0.5
        for b, n in Counter(((ord(p) * f[0] + ord(q) * f[1] + ord(s) * f[2]) % (1 << 64) >> 40) % 256 for p, q, s in zip(text, text[1:], text[2:])).items():
            x[656 + b] = (n / max(1, len(text) - 2)) ** 0.5
        n = max(1, len(words))
        again = sum(a == b for a, b in zip(words, words[1:])) / n
        x[-8:] = again, again**0.5, min(1, again * 5), len(set(words)) / n, 1 - len(set(lines)) / len(lines), min(1, len(text) / n / 20), np.log1p(len(words)) / 10, min(1, max(map(len, words), default=0) / 50)
        z = sum((x[i] - float(model.mean[i])) * float(model.scale[i]) * float(model.weight[i]) for i in range(quality.WIDTH)) + model.bias
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_sample_is_bounded_when_an_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITIVES", 20)
    monkeypatch.setattr(quality, "UNLABELLED", 30)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda pos, unl: seen.append((len(pos), len(unl))))
    docs = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    quality.train(docs, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert seen == [(20, 30)] or seen[0][0] == 20 and seen[0][1] <= 30


def test_good_documents_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"plain words stand here {i}", "mine", "own") for i in range(30)], "doc_id bigint, text string, score string, predicted string")
    kept = quality.good_documents(docs, spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int"))
    assert kept.columns == docs.columns and {(r["score"], r["predicted"]) for r in kept.collect()} <= {("mine", "own")}
