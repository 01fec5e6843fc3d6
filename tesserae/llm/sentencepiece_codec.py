"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model has a whitespace marker after another character, so a
merge can never cross from one marked word into the next.  The text is cut
into marked words (a run of markers and the characters up to the next one);
every distinct one is segmented once and its ids are joined back by position.
:func:`pieces_stay_in_words` proves the property for a model; one without it is
encoded whole.

The table belongs to a task and starts anew at :data:`TABLE_CHARS` characters,
so its memory is bounded and nothing is shuffled.

Defined cases: a null text is empty; an empty text has no ids and decodes to the
empty text; a literal U+2581 is a space, as the library has it; equal texts have
equal ids; input columns named like a result are replaced.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tesserae.llm import common

MARK = "▁"
#: Chunks longer than this are segmented where they stand and not kept.
LONG_CHUNK = 64
TABLE_CHARS = 1 << 20
_RUNS = re.compile(r" *[^ ]+| +$")


def pieces_stay_in_words(processor) -> bool:
    return not any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size()))


def chunks_of(text: str) -> list[str]:
    """Marked words of a text, each without the first of its markers.

    The library puts one marker before the text; every chunk begins with one.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in _RUNS.findall(" " + text)]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.lone_marker = [self.processor.piece_to_id(MARK)]
        self.by_word = pieces_stay_in_words(self.processor)
        self.table: dict[str, list[int]] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_word:
            return self.processor.encode(texts, num_threads=1)
        cut = [chunks_of(t) for t in texts]
        if self.held > TABLE_CHARS:
            self.table, self.held = {}, 0
        table = self.table
        new = [c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in table]
        made = dict(zip(new, self.processor.encode(new, num_threads=1), strict=True)) if new else {}
        if "" in made:  # a marker alone, at a text's end; the library has no ids for an empty text
            made[""] = self.lone_marker
        short = {c: ids for c, ids in made.items() if len(c) <= LONG_CHUNK}
        table.update(short)
        self.held += sum(map(len, short)) + 8 * len(short)
        known = table if len(short) == len(made) else {**table, **made}
        return [list(chain.from_iterable(map(known.__getitem__, c))) for c in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.processor.decode(x) for x in ids]


def encode(docs: DataFrame, model_file, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with an array column of ids. ``model_file``: a path, or a function that gives one on the executor."""
    schema = common.replaced(docs.schema, StructField(to, ArrayType(IntegerType())))

    def start():
        codec = Codec(_path(model_file))
        return lambda piece: {to: codec.encode(common.texts(piece, text))}

    return common.map_slices(docs, schema, text, start)


def decode(docs: DataFrame, model_file, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text that its ids decode to; null ids decode to the empty text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    import pyarrow as pa

    schema = common.replaced(docs.schema, StructField(to, StringType()))
    target = to_arrow_schema(schema)

    def run(batches):
        codec = Codec(_path(model_file))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                made = codec.decode([x or [] for x in piece.column(piece.schema.get_field_index(ids)).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(made, f.type) if f.name == to else piece.column(piece.schema.get_field_index(f.name)) for f in target], names=target.names)

    return docs.mapInArrow(run, schema)


def token_counts(docs: DataFrame, model_file, text: str = "text", to: str = "n_tokens", drop_text: bool = False) -> DataFrame:
    """``docs`` with the number of ids of each text."""
    schema = common.replaced(docs.schema, StructField(to, LongType()))
    if drop_text:
        schema = StructType([f for f in schema.fields if f.name != text])

    def start():
        codec = Codec(_path(model_file))
        return lambda piece: {to: [len(x) for x in codec.encode(common.texts(piece, text))]}

    return common.map_slices(docs, schema, text, start)


def round_trip(docs: DataFrame, model_file, text: str = "text") -> DataFrame:
    """doc_id and digests of the ids and of the text decoded from them, made beside the codec so that ids never leave the task."""
    import hashlib

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def start():
        codec = Codec(_path(model_file))
        names = [str(i) for i in range(codec.processor.get_piece_size())]

        def kernel(piece):
            ids = codec.encode(common.texts(piece, text))
            back = codec.decode(ids)
            return {
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back],
            }

        return kernel

    return common.map_slices(docs.select("doc_id", text), schema, text, start)


def _path(model_file) -> str:
    return model_file() if callable(model_file) else model_file
