"""WARC archives in Zstandard: one frame a record, the dictionary in front.

An archive begins with a skippable frame that holds the dictionary (itself
compressed, or as it is); every record is one frame of its own, compressed with that
dictionary.  The reader loads the dictionary, decodes frame by frame, and
checks each record's version line, header lines, block length and digests.

Archives are built and kept as rows of one binary column, each about
:data:`ARCHIVE_BYTES` of payload, so Spark's own readers and writers move them
and any shared store will do; :func:`read_archives` takes the ``content`` of
``spark.read.format("binaryFile")`` just as well, and :func:`save` writes ``.warc.zst`` files.

Of pages with equal payloads the one with the largest id is a response, the
others are revisits that name it and carry no payload.  Only digests and ids are
shuffled to find it.  Up to :data:`MOST_BROADCAST` repeated digests are broadcast, so no page moves; beyond
that a bit table of them holds back all pages but those whose payload (nearly surely) repeats, and only these move, a payload with more than
1 / :data:`common.HOT` of them not even then.

Defined cases: a null html is an empty payload; a null url is ``urn:page:<id>``, and bytes that a header
can't hold are percent-encoded; rows that share the largest id and the payload are all
responses; among equal payloads a null id is smaller than any other, and if all are null all are responses;
an empty table makes no archive; an archive without records is valid; a payload larger than an archive has one of its own;
damage raises ``ValueError``; other input columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tesserae.llm import bloom, common

ARCHIVE_BYTES = 4 << 20
MOST_BROADCAST = 1 << 20
DICTIONARY_BYTES = 16 << 10
#: Payloads that a dictionary is trained on, and bytes of each.
SAMPLES, SAMPLE_BYTES = 128, 4 << 10
LEVEL = 3
_SKIPPABLE = 0x184D2A5D
_FRAME = 0xFD2FB528
_DATE = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(data: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value: blanks, controls and what isn't ASCII as percent-encoded UTF-8."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(kind: str, uri: str, page: str, data: bytes, refers_to: str | None = None) -> bytes:
    """One record, uncompressed. A revisit's block has the HTTP headers alone."""
    block = _HTTP % len(data) + (data if kind == "response" else b"")
    own = hashlib.sha256(f"{kind}\n{page}\n{uri}".encode() + data).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:32]}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_line(uri)}",
        f"X-Page-Id: {page}", f"WARC-Payload-Digest: sha1:{digest(data)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(data)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(payloads: list[bytes]) -> bytes:
    """A dictionary from some of an archive's payloads; empty where there is too little to learn."""
    import zstandard

    step = max(1, len(payloads) // SAMPLES)
    sample = [p[:SAMPLE_BYTES] for p in payloads[::step][:SAMPLES] if p]
    if len(sample) < 8 or sum(map(len, sample)) < 4 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    import zstandard

    kept = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    if len(kept) >= len(dictionary):
        kept = dictionary
    with_dict = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **with_dict)
    return struct.pack("<II", _SKIPPABLE, len(kept)) + kept + b"".join(map(packer.compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """Records of an archive, decoded one frame at a time."""
    import zstandard

    if len(data) < 8:
        raise ValueError("an archive is cut off")
    magic, n = struct.unpack_from("<II", data)
    at, with_dict = 0, {}
    if magic == _SKIPPABLE:
        kept, at = data[8 : 8 + n], 8 + n
        if len(kept) != n:
            raise ValueError("the dictionary is cut off")
        if kept[:4] == struct.pack("<I", _FRAME):
            kept = zstandard.ZstdDecompressor().decompress(kept, max_output_size=1 << 24)
        if kept:
            with_dict = {"dict_data": zstandard.ZstdCompressionDict(kept)}
    reader = zstandard.ZstdDecompressor(**with_dict)
    while at < len(data):
        one, parts, size = reader.decompressobj(), [], 1 << 14
        try:
            while not one.eof:
                piece = data[at : at + size]
                if not piece:
                    raise ValueError("a frame is cut off")
                parts.append(one.decompress(piece))
                at += len(piece) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame is damaged: {e}") from None
        out = b"".join(parts)
        yield out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; raises ``ValueError`` where it is not well formed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("a record has no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError("a header line is malformed")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("a block's digest is wrong")
    return fields, block


def payload(fields: dict[str, str], block: bytes) -> bytes | None:
    """Payload of a response, checked; None for a revisit."""
    http, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("a block has no HTTP headers")
    if fields["warc-type"] == "revisit":
        return None
    if fields.get("warc-payload-digest") != f"sha1:{digest(body)}" or fields.get("x-payload-length", str(len(body))) != str(len(body)):
        raise ValueError("a payload's digest or length is wrong")
    return body


def with_kinds(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 0, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``pages`` with record_type and refers_to."""
    data = F.coalesce(F.col(html), F.lit("")).cast("binary")
    pages = pages.drop("record_type", "refers_to")
    own = F.when(F.octet_length(data) >= least, F.unhex(F.sha1(data)))
    groups = pages.select(F.col(key).alias("__id"), own.alias("__sha1")).filter("__sha1 IS NOT NULL")
    groups = groups.groupBy("__sha1").agg(F.max("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1 AND __first IS NOT NULL")
    groups = common.written(groups, "warc-repeated")
    many, held = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()
    given = pages.withColumn("__sha1", own)
    if many <= most_broadcast:
        joined = given.join(F.broadcast(groups), "__sha1", "left")
    else:
        head = F.substring("__sha1", 1, 16)
        table = bloom.table_of(groups.select(head.alias("d")), "d", bloom.bits_for(many))
        marked = common.written(bloom.flagged(given.select(F.monotonically_increasing_id().alias("__row"), "*"), head, table, "__again"), "warc-marked")
        again = marked.filter("__again")
        found = common.join_skewed(again.select("__row", "__sha1"), groups, "__sha1", "__n", held).select("__row", "__first")
        joined = again.join(found, "__row", "left").unionByName(marked.filter("NOT __again"), allowMissingColumns=True)
    revisit = F.col("__first").isNotNull() & ~F.col(key).eqNullSafe(F.col("__first"))
    return joined.select(*pages.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to"))


_ARCHIVE = StructType([StructField("records", LongType()), StructField("archive", BinaryType())])


def to_archives(kinds: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (records, archive) from pages with record_type and refers_to."""

    def run(batches):
        for batch in batches:
            for piece in common.slices(batch, html, most):
                rows = piece.select([key, url, html, "record_type", "refers_to"]).to_pylist()
                data = [(r[html] or "").encode() for r in rows]
                made = [
                    record(r["record_type"], f"urn:page:{r[key]}" if r[url] is None else r[url], "" if r[key] is None else str(r[key]), d, None if r["refers_to"] is None else str(r["refers_to"]))
                    for r, d in zip(rows, data, strict=True)
                ]
                own = archive(made, train([d for r, d in zip(rows, data, strict=True) if r["record_type"] == "response"]))
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([own], pa.binary())], names=_ARCHIVE.names)

    return kinds.mapInArrow(run, _ARCHIVE)


_READ = StructType([
    StructField("page", StringType()), StructField("uri", StringType()), StructField("record_type", StringType()), StructField("payload", BinaryType()),
    StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("refers_to", StringType()),
])


def read_archives(archives: DataFrame, content: str = "archive", with_payload: bool = True) -> DataFrame:
    """One row a record: page, uri, record_type, payload (null for revisits), payload_bytes and payload_digest (of the full payload), refers_to."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for data in frames(batch.column(batch.schema.get_field_index(content))[i].as_py()):
                    fields, block = parse(data)
                    body = payload(fields, block)
                    length = int(fields.get("x-payload-length", len(body or b"")))
                    rows.append((fields.get("x-page-id"), fields.get("warc-target-uri"), fields["warc-type"], body if with_payload else None, length, fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields.get("x-refers-to-page")))
                    held += len(data) if with_payload else 256
                    if held > common.SLICE_BYTES:
                        yield _read_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _read_batch(rows)

    return archives.select(content).mapInArrow(run, _READ)


def _read_batch(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_READ.names)


def save(archives: DataFrame, folder: str) -> int:
    """Write every archive as ``<number>.warc.zst`` to a folder that all executors share; returns how many."""

    def run(batches):
        from pyspark import TaskContext

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        n = 0
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("archive")).to_pylist():
                at = f"{base}/{TaskContext.get().partitionId():06d}-{n:06d}.warc.zst"
                part = f"{at}.{TaskContext.get().taskAttemptId()}.tmp"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, at)  # a task that runs again replaces its own files
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return archives.select("archive").mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write an archive of ``pages`` to the shared folder, read it back, and tell of each record."""
    kinds = with_kinds(pages.select("page_id", "url", "html"))
    stored = common.written(to_archives(kinds), "warc")
    read = read_archives(stored, with_payload=False)
    kind = pages.schema["page_id"].dataType
    return read.select(F.expr("nullif(page, '')").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
