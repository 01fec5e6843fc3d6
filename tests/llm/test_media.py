"""JPEG files: round trips, foreign files, damage, and the query's digests."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tesserae.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from tesserae.llm import media_jpeg as jpeg  # noqa: E402


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=700), st.text(max_size=400).map(str.encode), st.integers(0, 400).map(bytes)), min_size=1, max_size=6))
def test_payloads_come_back(texts):
    stored = [jpeg.padded(t) for t in texts]
    for p, (head, coef) in zip(stored, jpeg.decode(jpeg.encode(stored)), strict=True):
        assert jpeg.payload(head, coef) == p
        want = np.frombuffer(p, np.uint8)[::64].astype(int)
        got = jpeg.thumbnail(head, coef).ravel()[: len(want)]
        assert (got == np.clip(np.rint(want / 8 + 128), 0, 255)).all()


def _slow_decode(file):
    """Bit by bit, for one file."""
    head = jpeg._File(file)
    codes = {}
    for kind in (head.dc, head.ac):
        dht, code, at, own = head.dht[kind], 0, 16, {}
        for n in range(1, 17):
            for _ in range(dht[n - 1]):
                own[format(code, f"0{n}b")] = dht[at]
                code, at = code + 1, at + 1
            code <<= 1
        codes[kind] = own
    data, intervals, i = file[head.scan[0] : head.scan[1]], [bytearray()], 0
    while i < len(data):
        if data[i] == 255:
            if data[i + 1] == 0:
                intervals[-1].append(255)
            else:
                intervals.append(bytearray())
            i += 2
        else:
            intervals[-1].append(data[i])
            i += 1
    out, todo = [], head.wide * head.high
    for own in intervals:
        bits, at, before = "".join(format(b, "08b") for b in own), 0, 0
        for _ in range(min(head.interval or todo, todo)):
            block, k = [0] * 64, 0
            while k < 64:
                n = 1
                table = codes[head.dc if k == 0 else head.ac]
                while bits[at : at + n] not in table:
                    n += 1
                s = table[bits[at : at + n]]
                at += n
                size = s & 15
                v = int(bits[at : at + size] or "0", 2)
                if size and bits[at] == "0":
                    v -= (1 << size) - 1
                at += size
                if k == 0:
                    before += v
                    block[0], k = before, 1
                elif s == 0:
                    break
                else:
                    k += s >> 4
                    block[k] = v
                    k += 1
            out.append(block)
            todo -= 1
    return np.array(out)


def test_against_a_slow_decoder():
    rng = random.Random(3)
    payloads = [jpeg.padded(bytes(rng.choice([0, 0, 0, 97, 255, 32]) for _ in range(n))) for n in (1, 64, 500, 3000)] + [jpeg.padded(bytes(40) + b"\x01" + bytes(90))]
    for file, (_, coef) in zip(files := jpeg.encode(payloads), jpeg.decode(files), strict=True):
        assert (_slow_decode(file) == coef).all()


def test_file_without_restarts_and_with_other_tables():
    """A hand-made file: 16 x 8, quantised by 4, its own Huffman tables, negative coefficients."""
    dc, ac = [(0, 2), (3, 2), (4, 2)], [(0x00, 1), (0x02, 2), (0x31, 3)]
    codes = {**{("d", s): format(c, f"0{n}b") for s, (c, n) in jpeg._codes(dc).items()}, **{("a", s): format(c, f"0{n}b") for s, (c, n) in jpeg._codes(ac).items()}}
    bits = codes["d", 4] + "1000" + codes["a", 0x02] + "00" + codes["a", 0x31] + "1" + codes["a", 0] + codes["d", 3] + "010" + codes["a", 0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    file = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\x00" + b"\x04" * 64) + seg(0xC0, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00")
    file += seg(0xC4, jpeg._dht(0, dc)) + seg(0xC4, jpeg._dht(0x10, ac)) + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    ((head, coef),) = jpeg.decode([file])
    want = np.zeros((2, 64), int)
    want[0, :2], want[0, 5], want[1, 0] = (8, -3), 1, 8 - 5
    assert (coef == want).all() and (coef == _slow_decode(file)).all()
    assert jpeg.thumbnail(head, coef).tolist() == [[132, 130]]
    with pytest.raises(ValueError):
        jpeg.payload(head, coef)


def test_damage_is_found():
    (file,) = jpeg.encode([jpeg.padded(b"some text that is long enough " * 20)])
    for bad in (file[:-2], b"xx" + file[2:], file[:30], file.replace(b"\xff\xd0", b"\xff\xd3", 1), file[:2] + file[200:]):
        with pytest.raises(ValueError):
            jpeg.decode([bad])


def test_stored_texts(spark):
    texts = ["", None, "a", "é" * 33, "x" * 64, "nul\x00\x00s", "word " * 2000, "word " * 2000, "\x00" * 500]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, feature string")
    got = {r["doc_id"]: r for r in jpeg.stored_texts(docs).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        p = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[6]["feature"] == got[7]["feature"] and got[6]["media_sha256"] == got[7]["media_sha256"] and got[0]["feature"] == got[1]["feature"]
    shown = jpeg.with_features(jpeg.with_media(docs)).collect()
    assert all(got[r["doc_id"]]["feature"] == f"{r['width']}x{r['height']}:{r['thumbnail_hash']}" for r in shown)
    assert jpeg.stored_texts(docs.limit(0)).collect() == []
