"""Media columns: baseline JPEG written and read back in numpy.

The decoder parses the markers of a baseline file (SOI, APPn, COM, DQT, SOF0, DHT, DRI,
SOS, RSTn, EOI), Huffman-decodes its scan into quantised coefficients and
rebuilds a luminance thumbnail from the DC terms alone, one pixel for each 8 x 8
block.  Restart intervals are independent, so all intervals of all files of a slice are
decoded in step: one numpy operation handles a symbol of every interval.

The encoder stores a payload without loss in the format's own unit: byte k of
every 64 is coefficient k (zigzag order) of a block, quantised by 1.  Samples
would not do, since the cosine transform rounds.  The file carries
the payload's length in a comment.

Defined cases: a null text is empty; an empty text is one block of zeros; a payload of n blocks
makes an image of ceil(sqrt(n)) blocks a row, its last row filled with zero blocks; equal payloads
make equal files; damaged files raise ``ValueError``; input columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tesserae.llm import common

BLOCK = 64
#: Blocks of a restart interval.
INTERVAL = 4
_FF = 0xFF


def _codes(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length), for (symbol, length) by rising length."""
    out, code, last = {}, 0, lengths[0][1]
    for symbol, n in lengths:
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


#: DC: twelve categories of 4 bits. AC: text is mostly single coefficients of 7 or 6 bits,
#: so those symbols are short; every other (run, size) of baseline has 11 bits.
DC_LENGTHS = [(s, 4) for s in range(12)]
_SHORT = [(0x07, 1), (0x06, 2), (0x08, 3)]
AC_LENGTHS = _SHORT + [(s, 11) for s in [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))] if s not in {0x06, 0x07, 0x08}]


def _dht(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    counts = bytes(sum(n == k for _, n in lengths) for k in range(1, 17))
    return bytes([kind]) + counts + bytes(s for s, _ in lengths)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([_FF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC4, _dht(0x00, DC_LENGTHS) + _dht(0x10, AC_LENGTHS)), _segment(0xDD, INTERVAL.to_bytes(2, "big")), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
_DC = _codes(DC_LENGTHS)
_AC = _codes(AC_LENGTHS)
_DC_CODE = np.array([_DC[s][0] for s in range(12)], np.int64)
_AC_CODE, _AC_LEN = np.zeros(256, np.int64), np.zeros(256, np.int64)
for _s, (_c, _n) in _AC.items():
    _AC_CODE[_s], _AC_LEN[_s] = _c, _n
_SIZE = np.array([int(i).bit_length() for i in range(2048)], np.int64)


def padded(data: bytes) -> bytes:
    """``data`` with zeros up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def shape(blocks: int) -> tuple[int, int]:
    """Blocks a row and rows."""
    wide = math.isqrt(blocks - 1) + 1
    if wide > 8191:
        raise ValueError("too large for one image")
    return wide, -(-blocks // wide)


def _amplitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload (lengths are positive multiples of 64)."""
    shapes = [shape(len(p) // BLOCK) for p in payloads]
    blocks = np.array([w * h for w, h in shapes], np.int64)
    data = np.frombuffer(b"".join(p + bytes(n * BLOCK - len(p)) for p, n in zip(payloads, blocks.tolist(), strict=True)), np.uint8).reshape(-1, BLOCK).astype(np.int64)
    total = len(data)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    in_file = np.arange(total) - np.repeat(first_block[:-1], blocks)
    opens = in_file % INTERVAL == 0  # a restart interval begins: the DC prediction is 0
    dc = data[:, 0] - np.where(opens, 0, np.concatenate([[0], data[:-1, 0]]))
    dc_size = _SIZE[np.abs(dc)]
    block, place = np.nonzero(data[:, 1:])
    value = data[block, place + 1]
    size = _SIZE[value]
    per_block = np.bincount(block, minlength=total)
    first = np.concatenate([[0], np.cumsum(per_block)[:-1]])
    before = np.concatenate([[-1], place[:-1]])
    before[first[per_block > 0]] = -1
    run = place - before - 1
    jumps = run >> 4  # symbols for sixteen zeros
    jumps_block = np.bincount(block, weights=jumps, minlength=total).astype(np.int64)
    last = np.full(total, -1)
    last[block] = place
    ends = last < BLOCK - 2
    width = 1 + per_block + jumps_block + ends
    start = np.concatenate([[0], np.cumsum(width)])
    code, length = np.zeros(start[-1], np.int64), np.zeros(start[-1], np.int64)
    code[start[:-1]] = (_DC_CODE[dc_size] << dc_size) | _amplitude(dc, dc_size)
    length[start[:-1]] = 4 + dc_size
    jumped = np.cumsum(jumps)
    jumped_before = np.concatenate([[0], jumped])[first] if len(jumps) else np.zeros(total, np.int64)
    at = start[:-1][block] + 1 + (np.arange(len(block)) - first[block]) + (jumped - jumped_before[block])
    symbol = (run & 15) << 4 | size
    code[at] = (_AC_CODE[symbol] << size) | value
    length[at] = _AC_LEN[symbol] + size
    for k in range(1, int(jumps.max(initial=0)) + 1):
        own = at[jumps >= k] - k
        code[own], length[own] = _AC_CODE[0xF0], _AC_LEN[0xF0]
    close = start[1:][ends] - 1
    code[close], length[close] = _AC_CODE[0], _AC_LEN[0]

    # Bits to bytes; every interval begins on a byte and is filled up with ones.
    interval_start = start[:-1][opens]
    bits = np.add.reduceat(length, interval_start)
    size_of = (bits + 7) >> 3
    byte_start = np.concatenate([[0], np.cumsum(size_of)])
    runs = np.concatenate([[0], np.cumsum(length)[:-1]])
    interval = np.repeat(np.arange(len(bits)), np.diff(np.append(interval_start, len(length))))
    offset = runs - runs[interval_start][interval] + byte_start[:-1][interval] * 8
    word = code << (40 - (offset & 7) - length)
    out = np.zeros(byte_start[-1] + 5, np.int64)
    base = offset >> 3
    for lane in range(5):
        out += np.bincount(base + lane, weights=(word >> (32 - 8 * lane)) & 255, minlength=len(out))[: len(out)].astype(np.int64)
    out[byte_start[1:] - 1] |= (1 << (size_of * 8 - bits)) - 1
    out = out[: byte_start[-1]].astype(np.uint8)

    # A zero after every FF, and a restart marker between the intervals of a file.
    per_file = -(-blocks // INTERVAL)
    file_of = np.repeat(np.arange(len(payloads)), per_file)
    number = np.arange(len(bits)) - np.repeat(np.concatenate([[0], np.cumsum(per_file)[:-1]]), per_file)
    marked = np.append(file_of[1:] == file_of[:-1], False)
    grow = np.ones(len(out), np.int64)
    grow[out == _FF] += 1
    grow[byte_start[1:][marked] - 1] += 2
    to = np.concatenate([[0], np.cumsum(grow)])
    scan = np.zeros(to[-1], np.uint8)
    scan[to[:-1]] = out
    mark = to[byte_start[1:][marked]] - 2
    scan[mark], scan[mark + 1] = _FF, 0xD0 + number[marked] % 8
    cut = to[byte_start[np.concatenate([[0], np.cumsum(per_file)])]]
    scan = scan.tobytes()
    files = []
    for i, (payload, (w, h)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = _segment(0xC0, b"\x08" + (h * 8).to_bytes(2, "big") + (w * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        dqt, dht, dri, sos = _TABLES
        files.append(b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(payload)) + dqt + frame + dht + dri + sos + scan[cut[i] : cut[i + 1]] + b"\xff\xd9")
    return files


class _File:
    """Headers of one file and where its scan lies."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quant: dict[int, list[int]] = {}
        self.dht: dict[int, bytes] = {}
        self.interval, self.payload, self.width, at = 0, None, 0, 2
        while True:
            if at + 4 > len(data) or data[at] != _FF:
                raise ValueError("a marker is missing")
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            if n < 2 or len(body) != n - 2:
                raise ValueError("a segment is cut off")
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = [int.from_bytes(body[1 + i * wide : 1 + (i + 1) * wide], "big") for i in range(64)]
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n_codes = sum(body[1:17])
                    self.dht[body[0]] = body[1 : 17 + n_codes]
                    body = body[17 + n_codes :]
            elif marker == 0xC0:
                if body[0] != 8 or body[5] != 1:
                    raise ValueError("only 8-bit files of one component are read")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.table = body[8]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not a baseline file")
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xFE and body.startswith(b"payload "):
                self.payload = int(body[8:])
            elif marker == 0xDA:
                self.dc, self.ac = body[2] >> 4, 0x10 | body[2] & 15
                break
        if data[-2:] != b"\xff\xd9" or not self.width or not self.height:
            raise ValueError("the file is cut off")
        self.scan = at, len(data) - 2
        self.wide, self.high = -(-self.width // 8), -(-self.height // 8)

    def tables(self) -> bytes:
        try:
            return self.dht[self.dc] + b"|" + self.dht[self.ac]
        except KeyError:
            raise ValueError("a Huffman table is missing") from None


def _lookup(dht: bytes) -> np.ndarray:
    """For every 16 bits: length of the code they begin with, times 256, plus its symbol (0: none)."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(dht[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | dht[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode(files: list[bytes]) -> list[tuple[_File, np.ndarray]]:
    """Headers and quantised coefficients, shape (blocks, 64) in zigzag order, of each file."""
    heads = [_File(f) for f in files]
    out: list = [None] * len(files)
    groups: dict[bytes, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault(h.tables(), []).append(i)
    for own in groups.values():
        for i, c in zip(own, _decode_alike([files[i] for i in own], [heads[i] for i in own]), strict=True):
            out[i] = (heads[i], c)
    return out


def _decode_alike(files: list[bytes], heads: list[_File]) -> list[np.ndarray]:
    """Coefficients of files with the same Huffman tables."""
    table = np.concatenate([_lookup(heads[0].dht[heads[0].ac]), _lookup(heads[0].dht[heads[0].dc])])
    data = np.frombuffer(b"".join(f[h.scan[0] : h.scan[1]] + b"\xff\xd9" for f, h in zip(files, heads, strict=True)), np.uint8)
    after = np.append(data[1:], 0)
    marker = (data == _FF) & (after != 0)
    code = after[marker]
    if ((code < 0xD0) | ((code > 0xD7) & (code != 0xD9))).any():
        raise ValueError("an unknown marker in a scan")
    stuffing = np.zeros(len(data), bool)
    stuffing[1:] = (data[:-1] == _FF) & (data[1:] == 0)
    keep = ~stuffing
    keep[marker] = False
    keep[np.flatnonzero(marker) + 1] = False
    place = np.cumsum(keep)
    ends = place[marker]  # bytes kept before each marker: where its interval ends
    data = data[keep]
    blocks = np.array([h.wide * h.high for h in heads], np.int64)
    every = np.array([h.interval or h.wide * h.high for h in heads], np.int64)
    per_file = -(-blocks // every)
    if len(ends) != per_file.sum() or (code == 0xD9).sum() != len(files):
        raise ValueError("restart markers don't fit the image")
    first_interval = np.concatenate([[0], np.cumsum(per_file)[:-1]])
    number = np.arange(len(ends)) - np.repeat(first_interval, per_file)
    final = np.zeros(len(ends), bool)
    final[np.cumsum(per_file) - 1] = True
    if (code != np.where(final, 0xD9, 0xD0 + number % 8)).any():
        raise ValueError("restart markers are out of order")
    starts = np.concatenate([[0], ends[:-1]])
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    block = np.repeat(first_block[:-1], per_file) + number * np.repeat(every, per_file)
    stop = np.minimum(block + np.repeat(every, per_file), np.repeat(first_block[1:], per_file))

    window = np.concatenate([data, np.full(8, _FF, np.uint8)]).astype(np.uint64)
    window = window[:-4] << np.uint64(32) | window[1:-3] << np.uint64(24) | window[2:-2] << np.uint64(16) | window[3:-1] << np.uint64(8) | window[4:]
    window = window.astype(np.int64)  # 40 bits from each byte on
    coef = np.zeros(first_block[-1] * BLOCK, np.int16)
    pos, limit, k, at, last = starts * 8, ends * 8, np.zeros(len(ends), np.int64), block * BLOCK, stop * BLOCK
    while len(pos):
        bits = window[pos >> 3] << (pos & 7) & 0xFFFFFFFFFF
        opens = k == 0
        found = table[(bits >> 24) + (opens.astype(np.int64) << 16)]
        n, symbol = found >> 8, found & 255
        size = symbol & 15
        amplitude = (bits >> (40 - n - size)) & ((1 << size) - 1)
        pos = pos + n + size
        if (n == 0).any() or (pos > limit).any():
            raise ValueError("a scan is damaged")
        value = np.where(amplitude >> np.maximum(size - 1, 0) == 0, amplitude - (1 << size) + 1, amplitude)
        k = k + np.where(opens, 0, symbol >> 4)
        write = size > 0
        if (k[write] > 63).any():
            raise ValueError("a block overflows")
        coef[at[write] + k[write]] = value[write]
        k = np.where((symbol == 0) & ~opens, BLOCK, k + 1)
        done = k >= BLOCK
        if done.any():
            at = at + done * BLOCK
            k = np.where(done, 0, k)
            live = at < last
            if not live.all():
                if (limit - pos)[~live].max(initial=0) > 7:
                    raise ValueError("bits are left in an interval")
                pos, limit, k, at, last = pos[live], limit[live], k[live], at[live], last[live]
    coef = coef.reshape(-1, BLOCK)
    total = np.cumsum(coef[:, 0].astype(np.int64))
    before = np.where(block > 0, total[block - 1], 0)
    coef[:, 0] = total - np.repeat(before, stop - block)
    return [coef[a:b] for a, b in zip(first_block[:-1], first_block[1:], strict=True)]


def thumbnail(head: _File, coef: np.ndarray) -> np.ndarray:
    """Luminance of each block from its DC term: uint8, shape (rows, columns)."""
    mean = np.rint(coef[:, 0].astype(np.float64) * head.quant[head.table][0] / 8 + 128)
    return np.clip(mean, 0, 255).astype(np.uint8).reshape(head.high, head.wide)


def payload(head: _File, coef: np.ndarray) -> bytes:
    """The bytes that :func:`encode` stored."""
    if head.payload is None or coef.min() < 0 or coef.max() > 255 or head.payload > coef.size:
        raise ValueError("not a stored payload")
    return coef.astype(np.uint8).tobytes()[: head.payload]


def feature(head: _File, coef: np.ndarray) -> str:
    """Dimensions, and a hash of the thumbnail."""
    return f"{head.width}x{head.height}:{hashlib.sha256(thumbnail(head, coef).tobytes()).hexdigest()[:32]}"


def with_media(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """``docs`` with a JPEG file that holds each text."""
    schema = common.replaced(docs.schema, StructField(to, BinaryType()))
    return common.map_slices(docs, schema, text, lambda: lambda piece: {to: encode([padded(x or b"") for x in common.raw(piece, text)])})


def with_features(docs: DataFrame, media: str = "media") -> DataFrame:
    """``docs`` with width, height and thumbnail_hash of each file (null for a null file)."""
    schema = common.replaced(docs.schema, StructField("width", LongType()), StructField("height", LongType()), StructField("thumbnail_hash", StringType()))

    def kernel(piece):
        files = piece.column(piece.schema.get_field_index(media)).to_pylist()
        read = iter(decode([f for f in files if f is not None]))
        found = [None if f is None else next(read) for f in files]
        return {"width": [x and x[0].width for x in found], "height": [x and x[0].height for x in found], "thumbnail_hash": [x and feature(*x).partition(":")[2] for x in found]}

    return common.map_slices(docs, schema, media, lambda: kernel)


_RESULT = [
    StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()),
]


def stored_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and digests of every text's JPEG file and of what is read back from its bytes."""

    def kernel(piece):
        data = [x or b"" for x in common.raw(piece, text)]
        files = encode([padded(x) for x in data])
        read = decode(files)
        back = [payload(*x) for x in read]
        return {
            "n_bytes": [len(x) for x in data],
            "payload_bytes": [len(x) for x in back],
            "payload_sha256": [hashlib.sha256(x).hexdigest() for x in back],
            "tail_crc32": [zlib.crc32(x[-BLOCK:]) for x in back],
            "media_bytes": [len(f) for f in files],
            "media_sha256": [hashlib.sha256(f).hexdigest() for f in files],
            "feature": [feature(*x) for x in read],
        }

    schema = StructType([docs.schema["doc_id"], *_RESULT])
    return common.map_slices(docs.select("doc_id", text), schema, text, lambda: kernel, most=1 << 19)
