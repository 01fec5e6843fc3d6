"""Line dedup, SentencePiece, packing and sharding against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tesserae.llm")
from pyspark.sql import functions as F  # noqa: E402

from tesserae.llm import line_dedup, packing, sentencepiece_codec, sharding  # noqa: E402
from tesserae.llm.queries import piece_model  # noqa: E402

DOCS = "doc_id bigint, text string, n_lines string, lang string"


def _docs():
    rng = random.Random(5)
    lines = ["Alpha beta", " alpha BETA\t", "x", "", "Éa", "éa", "long " * 50, "\x0b\x0c", "same\r"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))), "clash", None) for i in range(60)]
    return rows + [(100, None, None, "en"), (101, "", None, "en"), (None, "x\nonly", None, None), (3, rows[3][1], "again", None)]


def _by_hand(rows, least):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)}) for x in (t or "").split("\n")]
    seen = Counter(k for r in rows for k in set(keys(r[1])))
    gone = {k for k, n in seen.items() if n >= least and k}
    out = []
    for r in rows:
        stay = [x for x, k in zip((r[1] or "").split("\n"), keys(r[1]), strict=True) if k not in gone]
        n = len((r[1] or "").split("\n"))
        out.append((r[0], n, n - len(stay), None if r[1] is None else "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [None, 1 << 7])
@pytest.mark.parametrize("most", [line_dedup.MOST_BROADCAST, 0])
def test_line_dedup(spark, bits, most):
    rows = _docs()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3), min_docs=10, bits=bits, most_broadcast=most)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == _by_hand(rows, 10)
    assert set(got.columns) == {"doc_id", "text", "n_lines", "n_dropped", "lang"}


def test_line_dedup_first_stays(spark):
    rows = [(i, "a\nb%d\nA" % i) for i in range(5)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), min_docs=2, keep_first_by="doc_id")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: "a\nb0", **{i: f"b{i}" for i in range(1, 5)}}


def test_line_dedup_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


ODD = ["", " ", "  ", "a", " a", "a ", "  a  b  ", "▁", "a▁b", "▁▁a", "x\ny  z", "\x00\x01", "日本語 テキスト", "😀 emoji", "tab\tnl\n", "<s> </s> <unk>", "word " * 3000, "q" * 5000, "<0x0A>", "é" * 70 + " é"]


def test_chunks_encode_like_the_library():
    rng = random.Random(1)
    alphabet = list("ab cé▁ \n\tZ0.日") + ["the ", "ing", "  "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    codec = sentencepiece_codec.Codec(piece_model())
    assert codec.by_word
    for group in itertools.batched(texts, 100):
        assert codec.encode(list(group)) == codec.processor.encode(list(group), num_threads=1)


def test_round_trip(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in sentencepiece_codec.round_trip(docs, piece_model).collect()}
    for i, t in rows:
        ids = p.encode(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(p.decode(ids).encode()).hexdigest()
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, piece_model), piece_model)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: p.decode(p.encode(t or "")) for i, t in rows}
    assert sentencepiece_codec.round_trip(docs.limit(0), piece_model).collect() == []


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 60), 8, replace=False))
        counts = rng.integers(1, 9, 8)
        cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lengths, counts, strict=True))  # noqa: E731,B023
        got = packing.boundaries(lengths, counts, 3)
        assert cost(got) == min(cost((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], 2))
    assert packing.boundaries(np.array([], int), np.array([], int), 3) == []


def test_boundaries_of_long_texts_are_optimal():
    rng = np.random.default_rng(7)

    def plain(lengths, counts, k):
        best = {0: 0}
        for _ in range(k):
            best = {j: min((best[i] + lengths[j - 1] * sum(counts[i:j]) for i in best if i < j), default=None) for j in range(1, len(lengths) + 1)} | {0: 0}
            best = {j: c for j, c in best.items() if c is not None}
        return best[len(lengths)] - sum(n * c for n, c in zip(lengths, counts, strict=True))

    for _ in range(30):
        lengths = sorted(map(int, rng.choice(np.arange(1025, 10**6), 60, replace=False)))
        counts = [int(c) for c in rng.choice([1, 1, 2, 50, 10**6], 60)]
        for k in (1, 2, 5, 16, 80):
            got = packing.boundaries(np.array(lengths), np.array(counts), k)
            assert len(got) <= k and set(got) <= set(lengths)
            assert sum(c * (min(x for x in got if x >= n) - n) for n, c in zip(lengths, counts, strict=True)) == plain(lengths, counts, min(k, 60))


def test_packed_table_equals_a_plain_packer(spark):
    """pack_documents over every text of the small table against the library's counts and a packer in plain Python."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = {r["doc_id"]: len(p.encode(r["text"] or "")) for r in docs.select("doc_id", "text").collect()}
    got = packing.pack_documents(docs, piece_model, buckets=8, budget=8192).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == tokens
    lengths, counts = np.unique([max(1, n) for n in tokens.values()], return_counts=True)
    bounds = packing.boundaries(lengths, counts, 8)
    for r in got:
        own = next(j for j, b in enumerate(bounds) if b >= max(1, tokens[r["doc_id"]]))
        assert (r["bucket"], r["bucket_length"], r["padding"]) == (own, bounds[own], bounds[own] - tokens[r["doc_id"]])
    for b, bound in enumerate(bounds):
        own = Counter(r["batch"] for r in got if r["bucket"] == b)
        fit, n = max(1, 8192 // bound), sum(own.values())
        assert own == Counter(i // fit for i in range(n))
        assert {(r["batch"], r["place"]) for r in got if r["bucket"] == b} == {divmod(i, fit) for i in range(n)}


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i % 150, rng.choice([0, 1, 5, 5, 5, 300, 5000, 100_000])) for i in range(200)] + [(None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), buckets=4, budget=4096).collect()
    assert len(got) == len(rows)
    places = Counter((r["bucket"], r["batch"], r["place"]) for r in got)
    assert max(places.values()) == 1
    for bucket, own in itertools.groupby(sorted(got, key=lambda r: r["bucket"]), key=lambda r: r["bucket"]):
        own = list(own)
        upper = own[0]["bucket_length"]
        sizes = Counter(r["batch"] for r in own)
        fit = max(1, 4096 // upper)
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(n == fit for b, n in sizes.items() if b < len(sizes) - 1) and sizes[len(sizes) - 1] <= fit
        assert all((r["n_tokens"] or 0) <= upper and r["padding"] == upper - (r["n_tokens"] or 0) for r in own)
    empty = packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"))
    assert empty.collect() == []


def test_sharding(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 50), "k") for i in range(3000)] + [(None, "n", "k"), (5, "dup", "k"), (5, "dup", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        assert of.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
    for shard in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    by_id = {(r["doc_id"], r["text_crc32"]): r["size"] for r in got}
    for i, t, _ in rows:
        data = (t or "").encode()
        assert by_id[i, zlib.crc32(data)] == len(data) + 8
    part = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs.filter("doc_id % 3 = 0")).collect()}
    assert all(of[i][0] == s for i, s in part.items())
    assert sharding.shard_documents(docs.limit(0)).collect() == []


def test_rebalancing_evens_bytes(spark):
    first = sharding.initial_map(spark, 4, 64)
    load = spark.createDataFrame([(i, 1000 if i % 4 == 0 else 100) for i in range(64)], "vslot int, slot_bytes bigint")
    second = sharding.rebalanced_map(first, load)
    assert second.count() == 64 and [r["version"] for r in second.select("version").distinct().collect()] == [2]
    held = {r["shard"]: r["b"] for r in second.join(load, "vslot").groupBy("shard").agg(F.sum("slot_bytes").alias("b")).collect()}
    assert max(held.values()) - min(held.values()) <= 1500
    moved = first.alias("a").join(second.alias("b"), "vslot").filter("a.shard <> b.shard")
    assert moved.filter("a.shard <> 0").count() == 0


def test_map_is_stored_read_and_edited(spark, tmp_path):
    """Growing and rebalancing on the bytes of real rows, through the stored versions."""
    rows = [(i, "x" * (5000 if i % 97 < 5 else i % 300)) for i in range(5000)]
    path = f"file://{tmp_path}/map"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.shard_documents(docs, shards=6, slots=256, path=path)
    own = {(r["vslot"], r["shard"]) for r in got.collect()}
    first, second = (sharding.load_map(spark, path, v).collect() for v in (1, 2))
    assert len(first) == len(second) == 256 and own <= {(r["vslot"], r["shard"]) for r in first}
    assert sum(r["slot_rows"] for r in first) == len(rows) and sum(r["slot_bytes"] for r in first) == sum(len(t) + 8 for _, t in rows)
    assert all(b["shard"] in (a["shard"], 6) for a, b in zip(sorted(first), sorted(second), strict=True))
    latest = sharding.load_map(spark, path)
    assert latest.select("version").distinct().first()[0] == 2
    sharding.store_map(sharding.with_load(sharding.rebalanced_map(latest, latest), latest.select("vslot", "slot_rows", "slot_bytes")), path)
    held = lambda v: {r["shard"]: r["b"] for r in sharding.load_map(spark, path, v).groupBy("shard").agg(F.sum("slot_bytes").alias("b")).collect()}
    spread = lambda h: max(h.values()) - min(h.values())
    assert spread(held(3)) < spread(held(2)) / 2 and sum(held(3).values()) == sum(held(1).values())


def test_sharding_a_very_long_text(spark):
    rows = [(1, "é" * 3_000_000), (2, None)]
    got = {r["doc_id"]: r for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["size"] == 6_000_008 and got[1]["text_crc32"] == zlib.crc32(("é" * 3_000_000).encode()) and got[2]["size"] == 8


def test_line_dedup_result_names(spark):
    docs = spark.createDataFrame([(i, "same\nown %d" % i, "mine") for i in range(12)], "doc_id bigint, text string, n_lines string")
    got = line_dedup.dedup_lines(docs, names=("a", "b")).collect()
    assert {(r["n_lines"], r["a"], r["b"]) for r in got} == {("mine", 2, 1)}
