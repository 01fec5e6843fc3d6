"""Queries over images and words, each with SQL that computes the same another way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae import families
from tesserae.config import DetectorConfig, QuadParams, gaussian_kernel
from tesserae.detector import DetectorBuilder
from tesserae.operators import decode, frames, pixels, reconcile
from tesserae.sources import bridges, scenes

KERNEL = gaussian_kernel(0.8)
OUT = ("image_id", "x", "y", "v")
QUERIES: dict = {}
SQL: dict[str, str] = {}

# SQL of the bridges.
_F8 = """f8 AS (SELECT vec_id AS image_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y,
  greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.5) * 255)))::INT AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
_MO = _F8 + """, mo AS (SELECT image_id // 100 AS image_id, (image_id % 100 % 10) * 8 + x AS x, (image_id % 100 // 10) * 8 + y AS y, v FROM f8)"""
_X4 = _MO + """, x4 AS (SELECT image_id, x * 4 + a.range AS x, y * 4 + b.range AS y, v FROM mo, range(4) a, range(4) b)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _px(name: str, view, op, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: op(view(spark, sf_dir)).select(*OUT)
    SQL[name] = sql


_px("px_frames8", bridges.frames8, lambda p: p, f"WITH {_F8} SELECT * FROM f8")
_px("px_mosaic", bridges.mosaic, lambda p: p, f"WITH {_MO} SELECT * FROM mo")
_px("darken_map", bridges.mosaic, pixels.darken, f"WITH {_MO} SELECT image_id, x, y, v // 2 AS v FROM mo")
_px("invert_map", bridges.mosaic, pixels.invert, f"WITH {_MO} SELECT image_id, x, y, 255 - v AS v FROM mo")
for _k in (2, 3):
    _px(f"decimate_{_k}", bridges.mosaic, lambda p, k=_k: pixels.decimate(p, k), f"WITH {_MO} SELECT image_id, x // {_k} AS x, y // {_k} AS y, v FROM mo WHERE x % {_k} = 0 AND y % {_k} = 0")
_px(
    "decimate_three_halves", bridges.frames_odd, pixels.decimate_three_halves,
    f"""WITH {_MO}, c AS (SELECT image_id, x, y, v FROM mo WHERE x < 78 AND y < 75), o AS (SELECT * FROM (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(dx, dy))
SELECT a.image_id, (a.x // 3) * 2 + dx AS x, (a.y // 3) * 2 + dy AS y, (4 * a.v + 2 * b.v + 2 * d.v + e.v) // 9 AS v
FROM o JOIN c a ON a.x % 3 = 2 * dx AND a.y % 3 = 2 * dy
JOIN c b ON b.image_id = a.image_id AND b.x = a.x - a.x % 3 + 1 AND b.y = a.y
JOIN c d ON d.image_id = a.image_id AND d.x = a.x AND d.y = a.y - a.y % 3 + 1
JOIN c e ON e.image_id = a.image_id AND e.x = b.x AND e.y = d.y""",
)


def _conv_sql(of: str, along: str, across: str, size: int) -> str:
    n, half = len(KERNEL), len(KERNEL) // 2
    taps = " + ".join(f"{k} * p{i}.v" for i, k in enumerate(KERNEL))
    joins = " ".join(f"LEFT JOIN {of} p{i} ON p{i}.image_id = a.image_id AND p{i}.{across} = a.{across} AND p{i}.{along} = a.{along} + {i - half}" for i in range(n))
    return f"SELECT a.image_id, a.x, a.y, CASE WHEN a.{along} >= {half} AND a.{along} < {size - n + half} THEN least(255, (127 + {taps}) >> 8) ELSE a.v END AS v FROM {of} a {joins}"


_BL = f"{_MO}, bh AS ({_conv_sql('mo', 'x', 'y', 80)}), bv AS ({_conv_sql('bh', 'y', 'x', 80)})"
_px("blur_h", bridges.mosaic, lambda p: pixels.blur_rows(p, KERNEL), f"WITH {_BL} SELECT * FROM bh")
_px("blur_sep", bridges.mosaic, lambda p: pixels.blur(p, KERNEL), f"WITH {_BL} SELECT * FROM bv")
_px("sharpen", bridges.mosaic, lambda p: pixels.sharpen(p, KERNEL), f"WITH {_BL} SELECT image_id, x, y, greatest(0, least(255, 2 * mo.v - bv.v)) AS v FROM mo JOIN bv USING (image_id, x, y)")
_px("window_slice", bridges.mosaic, lambda p: pixels.around(p, 10, 78, 3, 4), f"WITH {_MO} SELECT image_id, x - 7 AS x, y - 74 AS y, v FROM mo WHERE x BETWEEN 7 AND 13 AND y BETWEEN 74 AND 82")


@query("rgb_to_luma", f"WITH {_MO} SELECT image_id, x, y, (v + 2 * (255 - v) + v // 2) // 4 AS v FROM mo")
def rgb_to_luma(spark, sf_dir):
    m = bridges.mosaic(spark, sf_dir)
    rgb = m.select("image_id", "w", "h", "x", "y", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), F.floor(F.col("v") / 2).cast("int").alias("b"))
    return pixels.luma(rgb).select(*OUT)


def _tiles(of: str, tw: int, th: int) -> str:
    return f"tl AS (SELECT image_id, x // 4 AS tx, y // 4 AS ty, min(v) AS mn, max(v) AS mx FROM {of} WHERE x < {tw * 4} AND y < {th * 4} GROUP BY ALL)"


def _spread(reach: int) -> str:
    return f"sp AS (SELECT a.image_id, a.tx, a.ty, min(b.mn) AS mn, max(b.mx) AS mx FROM tl a JOIN tl b ON a.image_id = b.image_id AND b.tx BETWEEN a.tx - 1 AND a.tx + {reach} AND b.ty BETWEEN a.ty - 1 AND a.ty + {reach} GROUP BY ALL)"


def _ternary(of: str, w: int, h: int) -> str:
    tw, th = w // 4, h // 4
    return f"""{_tiles(of, tw, th)}, {_spread(0)}, tn AS (SELECT p.image_id, p.x, p.y,
  CASE WHEN p.x < {tw * 4} AND p.y < {th * 4} AND s.mx - s.mn < 5 THEN 127 WHEN p.v > s.mn + (s.mx - s.mn) // 2 THEN 255 ELSE 0 END AS v
  FROM {of} p JOIN sp s ON s.image_id = p.image_id AND s.tx = least(p.x // 4, {tw - 1}) AND s.ty = least(p.y // 4, {th - 1}))"""


_CUT = _MO + ", od AS (SELECT * FROM mo WHERE x < 78 AND y < 77)"
query("tile_minmax", f"WITH {_MO}, {_tiles('mo', 20, 20)} SELECT * FROM tl")(lambda s, d: pixels.tile_minmax(bridges.mosaic(s, d)))
query("tile_blur_causal", f"WITH {_MO}, {_tiles('mo', 20, 20)}, {_spread(0)} SELECT * FROM sp")(lambda s, d: pixels.tile_spread(pixels.tile_minmax(bridges.mosaic(s, d))))
query("tile_blur_full", f"WITH {_MO}, {_tiles('mo', 20, 20)}, {_spread(1)} SELECT * FROM sp")(lambda s, d: pixels.tile_spread(pixels.tile_minmax(bridges.mosaic(s, d)), -1, 1))
_px("threshold", bridges.mosaic, pixels.threshold, f"WITH {_MO}, {_ternary('mo', 80, 80)} SELECT * FROM tn")
_px("threshold_odd", bridges.frames_odd, pixels.threshold, f"WITH {_CUT}, {_ternary('od', 78, 77)} SELECT * FROM tn")
QUERIES["threshold_arrow"] = lambda s, d: frames.unpack(frames.threshold(frames.pack(bridges.frames_odd(s, d)))).select(*OUT)
SQL["threshold_arrow"] = SQL["threshold_odd"]
_px(
    "threshold_bayer", bridges.mosaic, pixels.threshold_bayer,
    f"""WITH {_MO}, p AS (SELECT *, x // 32 AS tx, y // 32 AS ty, 2 * (y % 2) + x % 2 AS ph FROM mo),
t AS (SELECT image_id, ph, tx, ty, min(v) AS mn, max(v) AS mx FROM p GROUP BY ALL),
s AS (SELECT a.image_id, a.ph, a.tx, a.ty, min(b.mn) AS mn, max(b.mx) AS mx FROM t a JOIN t b ON a.image_id = b.image_id AND a.ph = b.ph AND abs(a.tx - b.tx) <= 1 AND abs(a.ty - b.ty) <= 1 GROUP BY ALL)
SELECT p.image_id, x, y, CASE WHEN v > mn + (mx - mn) // 2 THEN 1 ELSE 0 END AS v FROM p JOIN s USING (image_id, ph, tx, ty)""",
)
_px(
    "deglitch", bridges.mosaic, lambda p: pixels.deglitch(pixels.threshold(p)),
    f"""WITH {_MO}, {_ternary('mo', 80, 80)},
d1 AS (SELECT *, max(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM tn),
d2 AS (SELECT *, CASE WHEN x BETWEEN 1 AND 78 AND y BETWEEN 1 AND 78 THEN max(a) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE 255 END AS b FROM d1),
e1 AS (SELECT *, min(b) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM d2),
e2 AS (SELECT *, min(c) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d FROM e1)
SELECT image_id, x, y, CASE WHEN x BETWEEN 1 AND 78 AND y BETWEEN 1 AND 78 THEN d ELSE v END AS v FROM e2""",
)

# Components.


def _edges_sql(of: str, w: int) -> str:
    near = lambda n, dx, dy: f"LEFT JOIN {of} {n} ON {n}.image_id = a.image_id AND {n}.x = a.x + {dx} AND {n}.y = a.y + {dy}"
    return f"""nb AS (SELECT a.image_id, a.x, a.y, a.v, coalesce(l.v, -1) AS l, coalesce(u.v, -2) AS u, coalesce(ul.v, -3) AS ul, coalesce(ur.v, -4) AS ur
  FROM {of} a {near('l', -1, 0)} {near('u', 0, -1)} {near('ul', -1, -1)} {near('ur', 1, -1)} WHERE a.v <> 127 AND a.x BETWEEN 1 AND {w - 2}),
eg AS (
  SELECT image_id, y * {w} + x AS a, y * {w} + x - 1 AS b FROM nb WHERE l = v
  UNION ALL SELECT image_id, y * {w} + x, y * {w} + x - {w} FROM nb WHERE u = v AND (x = 1 OR NOT (l = ul AND ul = u))
  UNION ALL SELECT image_id, y * {w} + x, y * {w} + x - {w} - 1 FROM nb WHERE v = 255 AND ul = v AND (x = 1 OR NOT (l = ul OR u = ul))
  UNION ALL SELECT image_id, y * {w} + x, y * {w} + x - {w} + 1 FROM nb WHERE v = 255 AND ur = v AND u <> ur)"""


_T8 = f"{_F8}, {_ternary('f8', 8, 8)}"
_LB = f"""{_edges_sql('tn', 8)}, sy AS (SELECT image_id, a, b FROM eg UNION SELECT image_id, b, a FROM eg),
cl AS (SELECT image_id, y * 8 + x AS pix, y * 8 + x AS rep FROM tn UNION SELECT cl.image_id, sy.b, cl.rep FROM cl JOIN sy ON sy.image_id = cl.image_id AND sy.a = cl.pix),
lb AS (SELECT image_id, pix AS pix_id, min(rep) AS rep FROM cl GROUP BY ALL), sz AS (SELECT *, count(*) OVER (PARTITION BY image_id, rep) AS size FROM lb)"""


def _ternary8(spark, sf_dir):
    return pixels.threshold(bridges.frames8(spark, sf_dir))


query("cc_edges", f"WITH {_MO}, {_ternary('mo', 80, 80)}, {_edges_sql('tn', 80)} SELECT * FROM eg")(lambda s, d: pixels.component_edges(pixels.threshold(bridges.mosaic(s, d))))
query("cc_labels", f"WITH RECURSIVE {_T8}, {_LB} SELECT image_id, pix_id, rep FROM lb")(lambda s, d: frames.labels(frames.pack(_ternary8(s, d))).select("image_id", "pix_id", "rep"))
query("cc_sizes", f"WITH RECURSIVE {_T8}, {_LB} SELECT DISTINCT image_id, rep, size FROM sz")(lambda s, d: frames.labels(frames.pack(_ternary8(s, d))).filter("pix_id = rep").select("image_id", "rep", "size"))

# Clusters on 8 x 8 images, with a size limit of 2 so that small components count.
_LEAST = 2
_GP = f"""{_T8}, {_LB}, q AS (SELECT tn.image_id, tn.x, tn.y, tn.v, rep, size FROM tn JOIN sz ON sz.image_id = tn.image_id AND sz.pix_id = tn.y * 8 + tn.x),
o AS (SELECT * FROM (VALUES (1, 0), (0, 1), (-1, 1), (1, 1)) t(dx, dy)),
em AS (SELECT a.image_id, a.x, a.y, dx, dy, a.rep AS ra, b.rep AS rb, b.v - a.v AS d FROM q a, o JOIN q b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy
  WHERE a.v <> 127 AND a.x BETWEEN 1 AND 6 AND a.y <= 6 AND a.size > {_LEAST} AND b.size > {_LEAST} AND a.v <> b.v),
gp AS (SELECT image_id, greatest(ra, rb) AS c0, least(ra, rb) AS c1, 2 * x + dx AS x, 2 * y + dy AS y, dx * d AS gx, dy * d AS gy FROM em
  WHERE NOT (dx = -1 AND EXISTS (SELECT 1 FROM em p WHERE p.image_id = em.image_id AND p.y = em.y AND p.x = em.x - 1 AND p.dx = 1 AND p.dy = 1)))"""
_CL = f"""{_GP}, k AS (SELECT image_id, c0, c1, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, (min(x) + max(x)) AS cx, (min(y) + max(y)) AS cy FROM gp GROUP BY ALL HAVING count(*) >= 24 AND count(*) <= 64)"""


def _points8(spark, sf_dir):
    return pixels.gradient_points(frames.labels(frames.pack(_ternary8(spark, sf_dir))), _LEAST)


query("gradient_points", f"WITH RECURSIVE {_GP} SELECT * FROM gp")(lambda s, d: _points8(s, d).drop("w", "h"))
query("clusters", f"WITH RECURSIVE {_CL} SELECT image_id, c0, c1, n FROM k")(lambda s, d: pixels.clusters(_points8(s, d)).select("image_id", "c0", "c1", "n"))
query("cluster_bbox", f"WITH RECURSIVE {_CL} SELECT image_id, c0, c1, x0, x1, y0, y1 FROM k")(lambda s, d: pixels.clusters(_points8(s, d)).select("image_id", "c0", "c1", "x0", "x1", "y0", "y1"))
query("cluster_polarity", f"WITH RECURSIVE {_CL} SELECT k.image_id, k.c0, k.c1, sum((2 * g.x - cx) * g.gx + (2 * g.y - cy) * g.gy)::BIGINT AS dot2 FROM k JOIN gp g USING (image_id, c0, c1) GROUP BY ALL")(
    lambda s, d: pixels.clusters(_points8(s, d)).select("image_id", "c0", "c1", "dot2")
)

# Codewords.
_FAM = families.family("tag16h5")
_CODES = "co AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c}::BIGINT)" for i, c in enumerate(_FAM.codes)) + ") t(id, code))"
_OBS = "ob AS (SELECT o_orderkey, (o_orderkey * 40503 + o_custkey * 977) % 65536 AS word FROM orders)"
_ROT = "((({0} << 4) | ({0} >> 12)) & 65535)"


def _rot_sql(of: str, key: str) -> str:
    return f"ro AS (SELECT {key}, 0 AS rotation, word AS turned FROM {of} UNION ALL SELECT {key}, 1, {_ROT.format('word')} FROM {of} UNION ALL SELECT {key}, 2, (((word << 8) | (word >> 8)) & 65535) FROM {of} UNION ALL SELECT {key}, 3, (((word << 12) | (word >> 4)) & 65535) FROM {of})"


def _match_sql(errors: int) -> str:
    # Brute force: every word, rotation and code; the first by rotation, lowest agreeing chunk, id.
    return f"""hit AS (SELECT o_orderkey, rotation, id, bit_count(xor(turned, code)) AS hamming,
  CASE WHEN xor(turned, code) & 15 = 0 THEN 0 WHEN xor(turned, code) & 240 = 0 THEN 1 WHEN xor(turned, code) & 3840 = 0 THEN 2 ELSE 3 END AS chunk
  FROM ro, co WHERE bit_count(xor(turned, code)) <= {errors}),
bs AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rotation, chunk, id) AS n FROM hit)
SELECT o_orderkey, 'tag16h5' AS family, id, hamming::INT AS hamming, rotation FROM bs WHERE n = 1"""


query("rotations4", f"WITH {_OBS}, {_rot_sql('ob', 'o_orderkey')} SELECT o_orderkey, rotation, turned FROM ro")(lambda s, d: decode.rotations(bridges.observed_words(s, d), "word", 16).drop("word"))
query("codeword_decode", f"WITH {_CODES}, {_OBS}, {_rot_sql('ob', 'o_orderkey')}, {_match_sql(2)}")(lambda s, d: decode.lookup(bridges.observed_words(s, d), _FAM))


@query("hamming_pairs", f"WITH {_CODES} SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.code, b.code))::INT AS hamming FROM co a JOIN co b ON a.id < b.id")
def hamming_pairs(spark, sf_dir):
    a = families.code_table(spark, [_FAM])
    b = F.broadcast(a.select(F.col("id").alias("id_b"), F.col("code").alias("code_b")))  # a family's codes
    return a.join(b, F.col("id") < F.col("id_b")).select(F.col("id").alias("id_a"), "id_b", F.bit_count(F.col("code").bitwiseXOR(F.col("code_b"))).alias("hamming"))


def _known_words(spark, sf_dir):
    """A code turned and with up to two bits flipped, by keys."""
    o = bridges.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).alias("id"), (F.col("o_custkey") % 4).alias("turn"), (F.col("o_custkey") % 3).alias("flips"), (F.col("o_orderkey") % 16).cast("int").alias("bit"))
    words = o.join(F.broadcast(families.code_table(spark, [_FAM]).select(F.col("id").cast("bigint").alias("id"), "code")), "id")
    turned = decode.rotations(words, "code", 16).filter("rotation = turn")
    flip = F.when(F.col("flips") > 0, F.expr("shiftleft(1, bit)")).otherwise(0).bitwiseXOR(F.when(F.col("flips") > 1, F.expr("shiftleft(1, (bit + 5) % 16)")).otherwise(0))
    return turned.select("o_orderkey", F.col("turned").bitwiseXOR(flip.cast("bigint")).alias("word"))


query(
    "codeword_decode_known",
    f"""WITH {_CODES}, kn AS (SELECT o_orderkey, code, o_custkey % 4 AS turn, o_custkey % 3 AS flips, o_orderkey % 16 AS bit FROM orders JOIN co ON co.id = o_orderkey % 30),
ob AS (SELECT o_orderkey, xor(((code << (4 * turn)::INT) | (code >> (16 - 4 * turn)::INT)) & 65535, xor(CASE WHEN flips > 0 THEN 1::BIGINT << bit::INT ELSE 0 END, CASE WHEN flips > 1 THEN 1::BIGINT << ((bit + 5) % 16)::INT ELSE 0 END)) AS word FROM kn),
{_rot_sql('ob', 'o_orderkey')}, {_match_sql(2)}""",
)(lambda s, d: decode.lookup(_known_words(s, d), _FAM))
# The largest family in use: 587 codes of 36 bits, each turned, with up to two bits flipped, against all codes.
_F36 = families.family("tag36h11")
_CODES36 = "co AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c}::BIGINT)" for i, c in enumerate(_F36.codes)) + ") t(id, code))"


def _words36(spark, sf_dir):
    o = bridges.table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_orderkey") % 587).alias("id"), (F.col("o_custkey") % 4).alias("turn"), (F.col("o_custkey") % 3).alias("flips"), (F.col("o_orderkey") % 36).cast("int").alias("bit"))
    words = o.join(F.broadcast(families.code_table(spark, [_F36]).select(F.col("id").cast("bigint").alias("id"), "code")), "id")
    turned = decode.rotations(words, "code", 36).filter("rotation = turn")
    one = lambda bit: F.expr(f"shiftleft(1L, {bit})")
    flip = F.when(F.col("flips") > 0, one("bit")).otherwise(0).bitwiseXOR(F.when(F.col("flips") > 1, one("(bit + 5) % 36")).otherwise(0))
    return turned.select("o_orderkey", F.col("turned").bitwiseXOR(flip).alias("word"))


query(
    "codeword_decode_36h11",
    f"""SELECT o_orderkey, 'tag36h11' AS family, (o_orderkey % 587)::INT AS id, (o_custkey % 3)::INT AS hamming, ((4 - o_custkey % 4) % 4)::INT AS rotation FROM orders WHERE o_orderkey % 5 = 0""",
)(lambda s, d: decode.lookup(_words36(s, d), _F36))
query("chunk_stats_36h11", f"WITH {_CODES36}, n AS (SELECT c.range AS chunk, (code >> (9 * c.range)::INT) & 511 AS value, count(*) AS n FROM co, range(4) c GROUP BY ALL) SELECT 'tag36h11' AS family, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most FROM n")(lambda s, d: decode.index_stats(decode.index(s, _F36)))
_CH = f"{_CODES}, ix AS (SELECT 'tag16h5' AS family, id, code, c.range::INT AS chunk, (code >> (4 * c.range)::INT) & 15 AS value FROM co, range(4) c)"
query("chunk_index", f"WITH {_CH} SELECT * FROM ix")(lambda s, d: decode.index(s, _FAM))
query("chunk_stats", f"WITH {_CH}, n AS (SELECT family, chunk, value, count(*) AS n FROM ix GROUP BY ALL) SELECT family, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most FROM n GROUP BY family")(lambda s, d: decode.index_stats(decode.index(s, _FAM)))


@query(
    "family_min_distance",
    f"WITH {_CODES}, ow AS (SELECT id AS o_orderkey, code AS word FROM co), {_rot_sql('ow', 'o_orderkey')} SELECT 'tag16h5' AS family, min(bit_count(xor(turned, code)))::INT AS distance FROM ro JOIN co ON NOT (co.id = o_orderkey AND rotation = 0)",
)
def family_min_distance(spark, sf_dir):
    codes = families.code_table(spark, [_FAM])
    other = F.broadcast(codes.select(F.col("id").alias("id_b"), F.col("code").alias("code_b")))  # a family's codes
    pairs = decode.rotations(codes, "code", 16).join(other, (F.col("id") != F.col("id_b")) | (F.col("rotation") > 0))
    return pairs.groupBy("family").agg(F.min(F.bit_count(F.col("turned").bitwiseXOR(F.col("code_b")))).alias("distance"))


_BITS = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(_FAM.bits))


@query(
    "tag_render",
    f"""WITH {_CODES}, bi AS (SELECT * FROM (VALUES {_BITS}) t(pos, bx, y_)), g AS (SELECT id, code, a.range AS x, b.range AS y FROM co, range(8) a, range(8) b)
SELECT id, x, y, CASE WHEN bi.pos IS NOT NULL THEN ((code >> (15 - bi.pos)) & 1) * 255 WHEN x IN (0, 7) OR y IN (0, 7) THEN 255 ELSE 0 END AS v FROM g LEFT JOIN bi ON bi.bx + 1 = x AND bi.y_ + 1 = y""",
)
def tag_render(spark, sf_dir):
    return families.tag_pixels(spark, _FAM)


# Gray model and sharpening.


@query(
    "graymodel_moments",
    f"WITH {_MO} SELECT image_id, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS sxx, sum(x * y)::BIGINT AS sxy, sum(y * y)::BIGINT AS syy, sum(v)::BIGINT AS sv, sum(x * v)::BIGINT AS sxv, sum(y * v)::BIGINT AS syv FROM mo GROUP BY image_id",
)
def graymodel_moments(spark, sf_dir):
    return pixels.plane_moments(bridges.mosaic(spark, sf_dir))


# The plane through a whole grid: its slopes are those of the two single regressions.
@query(
    "graymodel_planes",
    f"WITH {_MO} SELECT image_id, round(regr_slope(v, x), 4) + 0.0::DOUBLE AS a, round(regr_slope(v, y), 4) + 0.0::DOUBLE AS b FROM mo GROUP BY image_id HAVING count(*) = 6400",
)
def graymodel_planes(spark, sf_dir):
    whole = pixels.plane_moments(bridges.mosaic(spark, sf_dir)).filter("n = 6400")
    return pixels.planes(whole).select("image_id", *[(F.round(n, 4) + F.lit(0.0)).alias(n) for n in ("a", "b")])


@query(
    "laplacian_sharpen",
    f"""WITH {_F8} SELECT a.image_id, a.x, a.y, round(a.v + 0.25 * (4 * a.v - coalesce(l.v, 0) - coalesce(r.v, 0) - coalesce(u.v, 0) - coalesce(d.v, 0)), 6)::DOUBLE AS v FROM f8 a
LEFT JOIN f8 l ON l.image_id = a.image_id AND l.x = a.x - 1 AND l.y = a.y LEFT JOIN f8 r ON r.image_id = a.image_id AND r.x = a.x + 1 AND r.y = a.y
LEFT JOIN f8 u ON u.image_id = a.image_id AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN f8 d ON d.image_id = a.image_id AND d.x = a.x AND d.y = a.y + 1""",
)
def laplacian_sharpen(spark, sf_dir):
    return pixels.laplacian(bridges.frames8(spark, sf_dir), 0.25).select("image_id", "x", "y", F.round("v", 6).alias("v"))


# Detection.

_SCENE = families.family(scenes.FAMILY)


def _detect(spark, sf_dir, names=(scenes.FAMILY,), make=scenes.scene, errors=2, **changes) -> DataFrame:
    builder = DetectorBuilder(DetectorConfig(**changes))
    for n in names:
        builder.add_family(n, errors)
    return builder.build().detect(scenes.frames(spark, sf_dir, names, make))


_TRUTH = f"SELECT p_partkey AS image_id, '{scenes.FAMILY}' AS family, (p_partkey % {len(_SCENE.codes)})::INT AS id, 0 AS hamming FROM part"
query("detect_scenes", _TRUTH)(lambda s, d: _detect(s, d).select("image_id", "family", "id", "hamming"))
query("detect_scenes_decimated", _TRUTH)(lambda s, d: _detect(s, d, quad_decimate=2.0).select("image_id", "family", "id", "hamming"))
_FOUND = ("image_id", "family", "id", "hamming")
query("detect_scenes_decimated_24", _TRUTH)(lambda s, d: _detect(s, d, quad_decimate=2.4).select(*_FOUND))
query("detect_scenes_36h11", f"SELECT p_partkey AS image_id, 'tag36h11' AS family, (p_partkey % 587)::INT AS id, 0 AS hamming FROM part")(lambda s, d: _detect(s, d, ("tag36h11",)).select(*_FOUND))
query(
    "detect_two_families",
    f"SELECT p_partkey AS image_id, 'tag25h9' AS family, (p_partkey % {len(_SCENE.codes)})::INT AS id, 0 AS hamming FROM part UNION ALL SELECT p_partkey, 'tag36h11', ((p_partkey + 1) % 587)::INT, 0 FROM part",
)(lambda s, d: _detect(s, d, (scenes.FAMILY, "tag36h11"), scenes.pair_scene, 1).select(*_FOUND))
# Markers on the tile grid, which the window of all neighbours finds.
_BLUR = QuadParams(full_blur=True)
query("detect_grid_full_blur", _TRUTH)(lambda s, d: _detect(s, d, make=scenes.grid_scene, qtp=_BLUR).select(*_FOUND))
_TILT = "[(30 + k % 7, 28 + k % 5), (82 - k % 6, 31 + k % 4), (86 + k % 3, 83 - k % 5), (28 + k % 4, 79 + k % 6)]"


@query(
    "detect_tilted",
    f"""WITH c AS (SELECT p_partkey AS image_id, unnest({_TILT.replace('k %', 'p_partkey %')}) AS c FROM part)
SELECT image_id, (image_id % 587)::INT AS id, 0 AS hamming, round(avg(c[1]))::BIGINT AS x, round(avg(c[2]))::BIGINT AS y, true AS within FROM c GROUP BY image_id""",
)
def detect_tilted(spark, sf_dir):
    """Markers in perspective with noise: id, the corners' mean, and whether every corner is within half a pixel of where it was drawn.

    With the window of all neighbours: the narrower one misses some three in a hundred of these (see README).
    """
    corners = F.expr(_TILT.replace("[(", "array(array(").replace("), (", "), array(").replace(")]", "))").replace("k %", "image_id %"))
    found = _detect(spark, sf_dir, ("tag36h11",), scenes.tilted_scene, qtp=_BLUR).withColumn("want", corners)
    point = lambda i: F.struct(F.element_at("corners", 2 * i + 1).alias("x"), F.element_at("corners", 2 * i + 2).alias("y"))
    got = F.array(*[point(i) for i in range(4)])
    near = F.forall("want", lambda w: F.exists(got, lambda g: F.hypot(g["x"] - w[0], g["y"] - w[1]) < 0.5))
    mean = lambda i: F.round(F.aggregate("want", F.lit(0.0), lambda s, w: s + w[i]) / 4).cast("bigint")
    return found.select("image_id", "id", "hamming", mean(0).alias("x"), mean(1).alias("y"), near.alias("within"))


_SCALE = "[4, 5, 6, 7][p_partkey % 4 + 1]"
# To half a pixel: the border's outer edges, doubled.
query(
    "detect_corners",
    f"""SELECT p_partkey AS image_id, (2 * ({scenes.MARGIN} + p_partkey % 3 + ring))::BIGINT AS left2, (2 * ({scenes.MARGIN} + p_partkey % 3 + side - ring))::BIGINT AS right2,
  (2 * ({scenes.MARGIN} + p_partkey % 2 + ring))::BIGINT AS top2, (2 * ({scenes.MARGIN} + p_partkey % 2 + side - ring))::BIGINT AS bottom2
FROM (SELECT p_partkey, {_SCALE} AS ring, {_SCENE.total_width} * {_SCALE} AS side FROM part)""",
)(
    lambda s, d: _detect(s, d).select(
        "image_id", *[F.floor(f(*[F.element_at("corners", i + at) for i in (0, 2, 4, 6)]) * 2 + 0.5).alias(n) for n, f, at in (("left2", F.least, 1), ("right2", F.greatest, 1), ("top2", F.least, 2), ("bottom2", F.greatest, 2))]
    )
)


@query("label_bijection", f"WITH RECURSIVE {_T8}, {_LB} SELECT image_id, true AS same FROM lb GROUP BY image_id")
def label_bijection(spark, sf_dir):
    """Whether the kernel's labels and those folded from links in Catalyst name the same components."""
    t = _ternary8(spark, sf_dir)
    return pixels.same_partition(frames.labels(frames.pack(t)), pixels.labels(t))


# The same comparison must fail where labels are wrong: pixels of unlike value are never in one component.
query("label_bijection_broken", f"WITH {_T8} SELECT image_id, count(DISTINCT v) = 1 AS same FROM tn WHERE v <> 127 AND x BETWEEN 1 AND 6 GROUP BY image_id")(
    lambda s, d: pixels.same_partition(*(lambda t: (t.select("image_id", (F.col("y") * 8 + F.col("x")).alias("pix_id"), F.col("v").alias("rep")), t.select("image_id", (F.col("y") * 8 + F.col("x")).alias("pix_id"), F.lit(1).alias("rep"))))(_ternary8(s, d).filter("v <> 127 AND x BETWEEN 1 AND 6")))
)
query("cc_labels_relational", f"WITH RECURSIVE {_T8}, {_LB} SELECT image_id, pix_id, rep FROM lb")(lambda s, d: pixels.labels(_ternary8(s, d)))


@query("image_diff", f"WITH {_BL} SELECT image_id, count(*) FILTER (WHERE mo.v <> bv.v) AS n_diff, max(abs(mo.v - bv.v))::INT AS max_diff FROM mo FULL JOIN bv USING (image_id, x, y) GROUP BY image_id")
def image_diff(spark, sf_dir):
    m = bridges.mosaic(spark, sf_dir)
    return pixels.difference(m, pixels.blur(m, KERNEL))


# Reconciliation.

_BOX = """bx AS (SELECT c_custkey AS det, c_custkey // 2 AS image_id, 'tag16h5' AS family, (c_custkey // 2 % 30)::INT AS id, (c_custkey % 3)::INT AS hamming, ((c_custkey * 31) % 64)::DOUBLE AS margin,
  (c_custkey * 7919) % 40 AS x0, (c_custkey * 104729) % 40 AS y0, 10 + c_custkey % 17 AS side FROM customer)"""
_WORSE = "(b.hamming < a.hamming OR (b.hamming = a.hamming AND b.margin > a.margin))"
_MEET = "a.x0 < b.x0 + b.side AND b.x0 < a.x0 + a.side AND a.y0 < b.y0 + b.side AND b.y0 < a.y0 + a.side"


def _boxes(spark, sf_dir):
    b = bridges.boxes(spark, sf_dir)
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("side"), F.col("y0") + F.col("side")
    return b.withColumn("corners", F.array(x0, y0, x1, y0, x1, y1, x0, y1)).drop("x0", "y0", "side")


query("reconcile_boxes", f"WITH {_BOX} SELECT det, image_id, id, hamming, margin FROM bx a WHERE NOT EXISTS (SELECT 1 FROM bx b WHERE b.image_id = a.image_id AND b.det <> a.det AND {_MEET} AND {_WORSE})")(
    lambda s, d: reconcile.reconcile(_boxes(s, d)).select("det", "image_id", "id", "hamming", "margin")
)
query("best_detection", f"WITH {_BOX} SELECT image_id, id, det, hamming FROM (SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY hamming, margin DESC, det) AS n FROM bx) WHERE n = 1")(
    lambda s, d: reconcile.best_of_tag(_boxes(s, d)).select("image_id", "id", "det", "hamming")
)
query("remove_indices", f"WITH {_BOX} SELECT det FROM bx WHERE det NOT IN (SELECT s_suppkey FROM supplier)")(
    lambda s, d: reconcile.without(_boxes(s, d), bridges.table(s, d, "supplier").select(F.col("s_suppkey").alias("det")), "det").select("det")
)
query("margin_filter", f"WITH {_BOX} SELECT det, margin FROM bx WHERE NOT margin < 32")(lambda s, d: reconcile.with_margin(_boxes(s, d), 32).select("det", "margin"))
query(
    "detection_order",
    f"WITH {_BOX} SELECT a.det, count(*) AS place FROM bx a JOIN bx b ON b.image_id = a.image_id AND (b.id, b.family, b.hamming, -b.margin, b.det) <= (a.id, a.family, a.hamming, -a.margin, a.det) GROUP BY a.det",
)(lambda s, d: reconcile.in_order(_boxes(s, d), "det").select("det", "place"))
