"""Marker families: geometry, codes, and DataFrames of both.

All families but 48h12, 49h12 and 52h13 come with their codes.  Those three get
theirs from a file of hexadecimal numbers, one a line in order of id - the form in which
they are published - with :func:`load_family`, or any family from any list with
:func:`custom_family`.  Bits lie in four-fold symmetry: the first quarter is stated
and turned three times.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tesserae import family_codes
from tesserae.config import FamilyError

# Published codes in order of id.
_TAG16H5 = """
27c8 31b6 3859 569c 6c76 7ddb af09 f5a1 fb8b 1cb9 28ca e8dc 1426 5770 9253 b702 063a 8f34 b4c0 51ec
e6f0 5fa4 dd43 1aaa e62f 6dbc b6eb de10 154d b57a
"""
_TAG25H9 = """
156f1f4 1f28cd5 16ce32c 1ea379c 1390f89 34fad0 7dcdb5 119ba95 1ae9daa df02aa 82fc15 465123 ceee98 1f17260
14429cd 17248a8 16ad452 9670ad 16f65b2 b8322b 5d715b 1a1c7e7 d7890d 1813522 1c9c611 99e4a4 855234 17b81c0
c294bb 89fae3 44df5f 1360159 ec31e8 1bcc0f6 a64f8d
"""
_CIRCLE21H7 = """
157863 47e28 1383ed 953c da68b 1cac50 bb215 16ceee 5d4b3 1ff751 efd16 72b3e 163103 106e56 1996b9 c0234
624d2 1fa985 344a5 762fb 19e92b 43755 1a4f4 10fad8 1b52 17e59f e6f70 ed47a c9931 14df2 a06f1 e5041
12ec03 16724e af1a5 8a8ac 15b39 1ec1e3
"""

# Bits (x, y) of the first quarter where no ring rule gives them.
_CIRCLE_21 = [(1, -2), (2, -2), (3, -2), (1, 1), (2, 1)]
_STANDARD_41 = [(-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (3, -2), (4, -2), (5, -2), (1, 1), (2, 1)]
_CIRCLE_49 = [(1, -3), (2, -3), (3, -3), (-1, -2), (0, -2), (1, -2), (2, -2), (3, -2), (4, -2), (5, -2), (1, 1), (2, 1)]
_CUSTOM_48 = [(-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (3, -2), (4, -2), (5, -2), (6, -2), (1, 1), (2, 1), (3, 1)]
_STANDARD_52 = [*_CUSTOM_48, (2, 2)]


@dataclass(frozen=True)
class Family:
    name: str
    bits: tuple[tuple[int, int], ...]
    width_at_border: int
    total_width: int
    reversed_border: bool
    min_hamming: int
    codes: tuple[int, ...] | None = None
    geometric: bool = True  # False: bits lie outside the stated grid, so only codewords can be looked up

    def need_codes(self) -> tuple[int, ...]:
        if self.codes is None:
            raise FamilyError(f"{self.name} has no codes; give them with load_family or custom_family")
        return self.codes


def _rings(d: int) -> tuple[tuple[int, int], ...]:
    """Quarter of a full d x d grid from 1: the rows of rings, without their last bit."""
    return tuple((x, r) for r in range(1, d // 2 + 1) for x in range(r, d + 1 - r))


def _turned(quarter, width: int, centre: tuple[int, int] | None = None) -> tuple[tuple[int, int], ...]:
    """The quarter, then turned by 90, 180 and 270 degrees, then the middle bit if there is one."""
    out, now = [], list(quarter)
    for _ in range(4):
        out += now
        now = [(width - 1 - y, x) for x, y in now]
    return tuple(out + ([centre] if centre else []))


def _square(name: str, d: int, hamming: int, codes: str | None = None) -> Family:
    middle = ((d + 1) // 2,) * 2 if d % 2 else None
    return Family(name, _turned(_rings(d), d + 2, middle), d + 2, d + 4, False, hamming, _parse(codes))


def _parse(codes: str | None) -> tuple[int, ...] | None:
    return None if codes is None else tuple(int(c, 16) for c in codes.split())


def _known() -> dict[str, Family]:
    every = [
        _square("tag16h5", 4, 5, _TAG16H5),
        _square("tag25h9", 5, 9, _TAG25H9),
        _square("tag36h10", 6, 10, family_codes.TAG36H10),
        _square("tag36h11", 6, 11, family_codes.TAG36H11),
        Family("tagCircle21h7", _turned(_CIRCLE_21, 5, (2, 2)), 5, 9, True, 7, _parse(_CIRCLE21H7)),
        # Its stated geometry doesn't hold its own bits.
        Family("tagStandard41h12", _turned(_STANDARD_41, 5, (2, 2)), 8, 10, False, 12, _parse(family_codes.STANDARD41H12), geometric=False),
        Family("tagCircle49h12", _turned(_CIRCLE_49, 5, (2, 2)), 5, 11, True, 12),
        Family("tagCustom48h12", _turned(_CUSTOM_48, 6), 6, 10, True, 12),
        Family("tagStandard52h13", _turned(_STANDARD_52, 6), 6, 10, True, 13),
    ]
    return {f.name: f for f in every}


FAMILIES = _known()


def names() -> list[str]:
    return sorted(FAMILIES)


def family(name: str) -> Family:
    try:
        return FAMILIES[name]
    except KeyError:
        raise FamilyError(f"no family {name!r}") from None


def custom_family(name: str, codes, base: Family | None = None, **geometry) -> Family:
    """A family with codes of one's own; with ``base`` its geometry, under the name of the base and ``(modified)``."""
    if base is not None:
        return replace(base, name=f"{base.name} (modified)", codes=tuple(codes))
    return Family(name, codes=tuple(codes), **geometry)


def load_family(name: str, path: str) -> Family:
    """A known family with the codes of a file."""
    with open(path) as f:
        return replace(family(name), codes=tuple(int(line, 16) for line in f if line.strip()))


# Codewords.


def rotate90(word: int, bits: int) -> int:
    """The word of a tag turned by a quarter; a middle bit stays the last one."""
    size, odd = (bits - 1, 1) if bits % 4 == 1 else (bits, 0)
    middle, ring = word & odd, word >> odd
    quarter = size // 4
    turned = (ring << quarter | ring >> (size - quarter)) & ((1 << size) - 1)
    return turned << odd | middle


def rotations(word: int, bits: int) -> list[int]:
    out = [word]
    for _ in range(3):
        out.append(rotate90(out[-1], bits))
    return out


def min_distance(fam: Family) -> int:
    """Least Hamming distance between different tags, or a tag and its own turned form."""
    turned = np.array([rotations(c, len(fam.bits)) for c in fam.need_codes()], np.uint64)
    best = 64
    for r in range(4):
        d = np.bitwise_count(turned[:, :1] ^ turned[:, r][None, :])
        np.fill_diagonal(d, 64 if r == 0 else d.diagonal().min())
        best = min(best, int(d.min()))
    return best


# DataFrames. Their size is fixed by the families, not by data, so they may be broadcast.


def family_table(spark: SparkSession) -> DataFrame:
    rows = [(f.name, f.width_at_border, f.total_width, f.reversed_border, f.min_hamming, len(f.bits)) for f in FAMILIES.values()]
    return spark.createDataFrame(rows, "family string, width_at_border int, total_width int, reversed_border boolean, min_hamming int, bits int")


def code_table(spark: SparkSession, families: list[Family]) -> DataFrame:
    return spark.createDataFrame([(f.name, i, c) for f in families for i, c in enumerate(f.need_codes())], "family string, id int, code bigint")


def bit_table(spark: SparkSession, families: list[Family]) -> DataFrame:
    return spark.createDataFrame([(f.name, i, x, y) for f in families for i, (x, y) in enumerate(f.bits)], "family string, pos int, bx int, by int")


def render(fam: Family, id_: int, transpose: bool = False) -> np.ndarray:
    """One pixel a cell: a light ring, the border, the payload; (x, y) of a bit is its column and row."""
    n = fam.total_width
    ring = (n - fam.width_at_border) // 2
    im = np.full((n, n), 255, np.uint8)
    im[ring : n - ring, ring : n - ring] = 0
    if fam.reversed_border:
        im = 255 - im
    code = fam.need_codes()[id_]
    for i, (x, y) in enumerate(fam.bits):
        at = (x + ring, y + ring) if transpose else (y + ring, x + ring)
        im[at] = 255 if code >> (len(fam.bits) - 1 - i) & 1 else 0
    return im


def tag_pixels(spark: SparkSession, fam: Family) -> DataFrame:
    """Every marker of a family as pixel rows (id, x, y, v): data bits, a border of one pixel around the marker's edge, and what lies between."""
    from pyspark.sql import functions as F

    n, ring = fam.total_width, (fam.total_width - fam.width_at_border) // 2
    side = F.sequence(F.lit(0), F.lit(n - 1))
    grid = code_table(spark, [fam]).withColumn("x", F.explode(side)).withColumn("y", F.explode(side))
    bits = F.broadcast(bit_table(spark, [fam]).select("pos", (F.col("bx") + ring).alias("x"), (F.col("by") + ring).alias("y")))  # at most 64 rows
    outside = F.least("x", "y", n - 1 - F.col("x"), n - 1 - F.col("y")) < ring
    one = F.expr(f"shiftright(code, {len(fam.bits) - 1} - pos)").bitwiseAND(F.lit(1)) * 255
    light, dark = (0, 255) if fam.reversed_border else (255, 0)
    return grid.join(bits, ["x", "y"], "left").select("id", "x", "y", F.when(F.col("pos").isNotNull(), one).when(outside, light).otherwise(dark).alias("v"))
