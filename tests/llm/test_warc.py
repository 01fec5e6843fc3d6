"""WARC archives: round trips, damage, revisits, files on disk."""

import random
import struct

import pytest

pytest.importorskip("tesserae.llm")
import zstandard  # noqa: E402

from tesserae.llm import warc  # noqa: E402


def _records(n=60):
    rng = random.Random(2)
    words = ["<p>", "alpha", "beta", "</p>", "gamma", "é", "\r\n\r\n"]
    return [" ".join(rng.choice(words) for _ in range(400)).encode() for _ in range(n)] + [b"", b"\r\n\r\n", b"x" * 200_000]


def test_round_trip_with_dictionary():
    data = _records()
    dictionary = warc.train(data)
    assert dictionary
    made = warc.archive([warc.record("response", f"http://x/{i} é\n", str(i), d) for i, d in enumerate(data)], dictionary)
    got = [warc.parse(f) for f in warc.frames(made)]
    assert [warc.payload(*g) for g in got] == data
    assert got[3][0]["warc-target-uri"] == "http://x/3%20%C3%A9%0A" and got[3][0]["warc-payload-digest"] == f"sha1:{warc.digest(data[3])}"
    n = struct.unpack_from("<I", made, 4)[0]
    with pytest.raises(zstandard.ZstdError):  # a frame needs its dictionary
        zstandard.ZstdDecompressor().decompress(made[8 + n :])
    plain = struct.pack("<II", 0x184D2A5D, len(dictionary)) + dictionary + made[8 + n :]
    assert [warc.payload(*warc.parse(f)) for f in warc.frames(plain)] == data
    assert list(warc.frames(warc.archive([], b""))) == []


def test_damage_is_found():
    made = warc.archive([warc.record("response", "u", "1", b"some text here"), warc.record("revisit", "u", "2", b"t", "1")], b"")
    assert [warc.payload(*warc.parse(f)) for f in warc.frames(made)] == [b"some text here", None]
    for bad in (made[:-3], made[:5], made[:40] + b"\x00" + made[41:], made + b"junk"):
        with pytest.raises(ValueError):
            [warc.parse(f) for f in warc.frames(bad)]
    good = warc.record("response", "u", "1", b"some text here")
    for a, b in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Date: ", b"Other: "), (b"WARC-Type:", b"WARC-Type"), (b"some text", b"SOME TEXT")):
        with pytest.raises(ValueError):
            warc.payload(*warc.parse(good.replace(a, b, 1)))


def test_pages(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 40}</p>" * 20) for i in range(100)] + [(500, None, None), (501, "u", ""), (None, "n", "<p>1</p>" * 20), (None, "n", None), (7, "http://h/7", "<p>7</p>" * 20), (600, "big", "b" * 3_000_000), (601, "big2", "b" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_type string").repartition(4)
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    got = sorted((tuple(r) for r in warc.archived_pages(pages).collect()), key=repr)
    want = []
    for i, _, h in rows:
        data, top = (h or "").encode(), first[h or ""]
        again = i != top
        want.append((i, len(data), warc.digest(data), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=repr)
    stored = warc.to_archives(warc.with_kinds(pages))
    assert warc.save(stored, f"file://{tmp_path}/out") >= 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"file://{tmp_path}/out")
    back = warc.read_archives(files, "content").collect()
    assert len(back) == len(rows)
    assert {bytes(r["payload"]) for r in back if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in rows}
    small = warc.with_kinds(pages, least=10_000).filter("record_type = 'revisit'").collect()
    assert [r["page_id"] for r in small] == [600]
    assert warc.archived_pages(pages.limit(0)).collect() == []


def test_kinds_beyond_the_broadcast_bound(spark):
    rows = [(i, "u", "same body" if i % 3 == 0 else f"body {i % 50}" if i % 3 == 1 else f"only {i}", "clash") for i in range(300)] + [(None, "u", "only null", "c"), (900, "u", None, "c"), (901, "u", "", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string").repartition(5)
    a, b = (sorted(map(tuple, warc.with_kinds(pages, most_broadcast=n).select("page_id", "html", "record_type", "refers_to").collect()), key=repr) for n in (1 << 20, 0))
    assert a == b and len(a) == len(rows)
    first = {}
    for i, _, html, _ in rows:
        first[html or ""] = max(first.get(html or "", -1), -1 if i is None else i)
    assert all((kind, to) == (("response", None) if i is None or first[html or ""] == i else ("revisit", first[html or ""])) for i, html, kind, to in a)
