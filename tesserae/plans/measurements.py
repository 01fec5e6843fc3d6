"""Queries over measurements and numeric functions, each with SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.config import Camera
from tesserae.functions import columns as cols
from tesserae.operators import analytics as an
from tesserae.operators import moments, pose
from tesserae.plans.images import _detect
from tesserae.sources import bridges

QUERIES: dict = {}
SQL: dict[str, str] = {}
_RUNS = """ru AS (SELECT event_type AS label, user_id % 7 AS image_id, event_id // 50 AS iter, event_id % 50 AS seq, 'stage' || (event_id % 5) AS stage,
  round(value * 100)::BIGINT AS wall, CASE WHEN user_id % 11 <> 0 THEN round(value * 70)::BIGINT END AS cpu, ts, event_id FROM events)"""


def q(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


_K = "PARTITION BY label, image_id, iter"
runs = bridges.runs
q("stage_duration", f"WITH {_RUNS} SELECT event_id, wall - coalesce(lag(wall) OVER ({_K} ORDER BY seq), 0) AS duration FROM ru", lambda s, d: an.stage_durations(runs(s, d)).select("event_id", "duration"))
q(
    "stage_cpu_duration",
    f"WITH {_RUNS} SELECT event_id, cpu - coalesce(lag(cpu) OVER ({_K} ORDER BY seq), 0) AS cpu_duration FROM ru WHERE cpu IS NOT NULL",
    lambda s, d: an.stage_durations(runs(s, d)).filter("cpu_duration IS NOT NULL").select("event_id", "cpu_duration"),
)
q(
    "stage_cumulative",
    f"WITH {_RUNS} SELECT event_id, (sum(wall) OVER ({_K} ORDER BY seq))::BIGINT AS cumulative, round((sum(wall) OVER ({_K} ORDER BY seq))::DOUBLE * 100 / (sum(wall) OVER ({_K}))::DOUBLE, 6) AS pct FROM ru",
    lambda s, d: an.cumulative(runs(s, d)).select("event_id", "cumulative", "pct"),
)
q("total_duration", f"WITH {_RUNS} SELECT label, image_id, iter, max(wall) - min(wall) AS total FROM ru GROUP BY ALL", lambda s, d: an.total_duration(runs(s, d)))
q("profile_stats_rms", f"WITH {_RUNS} SELECT stage, round(avg(wall), 6) AS mean, min(wall) AS least, max(wall) AS most, round(sqrt(avg((wall * wall)::DOUBLE)), 6) AS rms FROM ru GROUP BY stage", lambda s, d: an.profile_statistics(runs(s, d)))
q("summary_stats_pop", f"WITH {_RUNS} SELECT label, image_id, round(avg(wall), 6) AS mean, min(wall) AS least, max(wall) AS most, round(stddev_pop(wall), 6) AS std_pop FROM ru GROUP BY ALL", lambda s, d: an.summary_statistics(runs(s, d), ("label", "image_id")))
q("run_overview_samp", f"WITH {_RUNS} SELECT label, min(stage) AS first_stage, count(DISTINCT image_id) AS images, round(avg(wall), 6) AS mean, round(stddev_samp(wall), 6) AS std_samp FROM ru GROUP BY label", lambda s, d: an.run_overview(runs(s, d)))
q("stage_means", f"WITH {_RUNS} SELECT label, stage, round(avg(wall), 6) AS mean, arg_min(seq, iter * 100 + seq) AS first_seq FROM ru GROUP BY ALL", lambda s, d: an.stage_means(runs(s, d)))
q("stage_order", f"WITH {_RUNS} SELECT label, stage, arg_min(seq, iter * 100 + seq) AS place FROM ru GROUP BY ALL", lambda s, d: an.stage_order(runs(s, d)))
q("stage_means_filled", f"WITH {_RUNS} SELECT label, stage, round(avg(coalesce(cpu, 0)), 6) AS mean FROM ru GROUP BY ALL", lambda s, d: an.filled_means(runs(s, d)))
q("stage_pct", f"WITH {_RUNS} SELECT r.label, stage, round(avg(wall) * 100 / any_value(m), 6) AS pct FROM ru r JOIN (SELECT label, avg(wall) AS m FROM ru GROUP BY label) t ON t.label = r.label GROUP BY ALL", lambda s, d: an.stage_percent(runs(s, d)))
q(
    "stage_table_best",
    f"""WITH {_RUNS}, m AS (SELECT label, stage, avg(wall) AS m, stddev_samp(wall) AS s FROM ru GROUP BY ALL)
SELECT a.label, a.stage, round(a.m, 6) AS mean, round(a.s, 6) AS std_samp, round(a.m * 100 / (SELECT sum(b.m) FROM m b WHERE b.label = a.label), 6) AS pct, a.m = (SELECT min(b.m) FROM m b WHERE b.stage = a.stage) AS best FROM m a""",
    lambda s, d: an.stage_table(runs(s, d)),
)
q("known_stages", f"WITH {_RUNS} SELECT label, stage, round(avg(cpu), 6) AS mean FROM ru WHERE cpu IS NOT NULL GROUP BY ALL", lambda s, d: an.known_stages(runs(s, d)))
q("warm_up_excluded", f"WITH {_RUNS} SELECT event_id FROM ru WHERE iter >= 10", lambda s, d: an.without_warm_up(runs(s, d), 10).select("event_id"))
q(
    "detection_count",
    f"WITH {_RUNS} SELECT label, image_id, count(*) AS detection_count FROM ru r WHERE iter = (SELECT max(iter) FROM ru o WHERE o.label = r.label AND o.image_id = r.image_id) GROUP BY ALL",
    lambda s, d: an.last_count(runs(s, d)),
)
q(
    "hamming_histogram",
    "WITH b AS (SELECT c_nationkey AS file, (c_custkey % 10)::BIGINT AS hamming FROM customer) SELECT file, hamming, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT NULL, hamming, count(*) FROM b GROUP BY hamming",
    lambda s, d: an.hamming_histogram(bridges.table(s, d, "customer").select(F.col("c_nationkey").alias("file"), (F.col("c_custkey") % 10).alias("hamming")), "file"),
)
q(
    "hist_wall",
    f"""WITH {_RUNS}, s AS (SELECT stage, min(wall) AS lo, max(wall) AS hi FROM ru GROUP BY stage HAVING stddev_pop(wall) >= 0.001)
SELECT stage, least(((wall - lo) * 40) // (hi - lo), 39) AS bin, count(*) AS n FROM ru JOIN s USING (stage) GROUP BY ALL""",
    lambda s, d: an.histogram(runs(s, d), "wall", 40, "stage"),
)
q(
    "label_disambiguate",
    "SELECT o_orderkey, CASE WHEN n > 1 THEN label || ' (' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ')' ELSE label END AS shown FROM (SELECT o_orderkey, o_orderdate, 'run-' || o_custkey AS label, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)",
    lambda s, d: an.distinct_labels(bridges.table(s, d, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("label")), "label", "o_orderdate").select("o_orderkey", "shown"),
)
q(
    "base_label",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'run-' || c_custkey || ' (cpu, ' || (c_custkey % 8 + 1) || 't)' END AS shown FROM customer",
    lambda s, d: bridges.table(s, d, "customer").select("c_custkey", an.base_label(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.col("c_custkey"), F.lit("cpu"), F.col("c_custkey") % 8 + 1).alias("shown")),
)
q("label_prefix", f"WITH {_RUNS} SELECT event_id, label FROM ru WHERE label LIKE 'c%'", lambda s, d: an.with_prefix(runs(s, d), "label", "c").select("event_id", "label"))
_WELCH = f"""WITH {_RUNS}, a AS (SELECT label, count(wall) AS n, avg(wall) AS m, stddev_pop(wall) AS sp, var_samp(wall) AS v FROM ru GROUP BY label)
SELECT a.label AS run_a, b.label AS run_b, round(a.m, 6) AS mean_a, round(a.sp, 6) AS std_a, round(b.m, 6) AS mean_b, round(b.sp, 6) AS std_b, round((b.m - a.m) / a.m * 100, 6) AS diff_pct,
  round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
  round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 6) AS df FROM a JOIN a b ON a.label < b.label"""
q("pairwise_welch", _WELCH, lambda s, d: an.pairwise_welch(runs(s, d)))
_WELCH_STAGE = (
    _WELCH.replace("SELECT label, count(wall)", "SELECT stage, label, count(wall)").replace("GROUP BY label)", "GROUP BY ALL)").replace("SELECT a.label AS run_a", "SELECT a.stage, a.label AS run_a").replace("ON a.label < b.label", "ON a.stage = b.stage AND a.label < b.label")
)
q("pairwise_welch_stages", _WELCH_STAGE, lambda s, d: an.pairwise_welch(runs(s, d), by="stage"))
# The density of t from 0 to |t| by Simpson's rule in 4000 steps; a second query has t from 0 to 6 and other degrees of freedom.
_SIMPSON = """greatest(0, 1 - 2 * list_sum(list_transform(range(4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) *
  exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + pow(abs(t) * i / 4000, 2) / df, -(df + 1) / 2))) * abs(t) / 4000 / 3)"""
_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars"
q("pairwise_pvalue", f"SELECT run_a, run_b, round(p, 6) AS p, {_STARS} FROM (SELECT run_a, run_b, {_SIMPSON} AS p FROM ({_WELCH}))", lambda s, d: an.with_p_value(an.pairwise_welch(runs(s, d))).select("run_a", "run_b", an.r6(F.col("p")).alias("p"), "stars"))
q(
    "p_values",
    f"WITH t AS (SELECT p_partkey AS k, (p_partkey % 61) / 10.0::DOUBLE AS t, 1.5::DOUBLE + p_partkey % 47 AS df FROM part WHERE p_partkey <= 400) SELECT k, round(p, 6) AS p, {_STARS} FROM (SELECT k, {_SIMPSON} AS p FROM t)",
    lambda s, d: an.with_p_value(bridges.table(s, d, "part").filter("p_partkey <= 400").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") % 61) / 10.0).cast("double").alias("t"), (F.col("p_partkey") % 47 + 1.5).cast("double").alias("df"))).select("k", F.round("p", 6).alias("p"), "stars"),
)
q(
    "groupby_variables",
    f"""WITH {_RUNS} SELECT * FROM (SELECT 'label' AS variable, count(DISTINCT label) AS n_values, 'discrete' AS kind FROM ru UNION ALL SELECT 'image_id', count(DISTINCT image_id), CASE WHEN count(DISTINCT image_id) > 5 THEN 'continuous' ELSE 'discrete' END FROM ru
UNION ALL SELECT 'seq', count(DISTINCT seq), 'discrete' FROM ru UNION ALL SELECT 'wall', count(DISTINCT wall), CASE WHEN count(DISTINCT wall) > 5 THEN 'continuous' ELSE 'discrete' END FROM ru) WHERE n_values >= 2""",
    lambda s, d: an.groupby_variables(runs(s, d), ["label", "image_id", "seq", "wall"], {"seq": "discrete"}),
)
q("discrete_chart", f"WITH {_RUNS} SELECT image_id::VARCHAR AS category, round(avg(wall), 6) AS mean, round(stddev_samp(wall), 6) AS std_samp FROM ru GROUP BY image_id", lambda s, d: an.discrete_chart(runs(s, d), "image_id"))
q("continuous_chart", f"WITH {_RUNS} SELECT label, image_id, round(avg(wall), 6) AS mean, coalesce(round(stddev_samp(wall), 6), 0) AS std FROM ru GROUP BY ALL", lambda s, d: an.continuous_chart(runs(s, d), "image_id"))
q(
    "flatten_runs",
    f"WITH {_RUNS} SELECT label, image_id, iter, (sum(wall) OVER ({_K}))::BIGINT AS wall, stage || '-' || seq AS stage, wall AS stage_wall FROM ru",
    lambda s, d: an.from_records(an.to_records(runs(s, d))),
)
q("runs_union", f"WITH {_RUNS} SELECT label, count(*) AS n FROM (SELECT label FROM ru UNION ALL SELECT o_orderpriority FROM orders) GROUP BY label", lambda s, d: runs(s, d).select("label").unionByName(bridges.table(s, d, "orders").select(F.col("o_orderpriority").alias("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n")))
q(
    "profile_report",
    f"WITH {_RUNS}, t AS (SELECT *, max(wall) OVER ({_K}) AS total FROM ru) SELECT event_id, lpad(seq::VARCHAR, 2, ' ') || ' ' || rpad(stage, 32, ' ') || lpad(format('{{:.3f}}', wall / 1e3), 15, ' ') || lpad(((wall * 1000 // total) // 10)::VARCHAR, 5, ' ') || '.' || (wall * 1000 // total) % 10 || ' %' AS line FROM t",
    lambda s, d: an.profile_lines(runs(s, d)).select("event_id", "line"),
)
q(
    "profile_report_short",
    f"WITH {_RUNS} SELECT event_id, stage || ': ' || wall || ' us' AS line FROM ru",
    lambda s, d: an.profile_lines(runs(s, d), short=True).select("event_id", "line"),
)

# Moments, lines and maxima over measured points.

_LI = "li AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS x, (l_partkey % 100)::BIGINT AS y, 1 + (l_suppkey % 5)::BIGINT AS w FROM lineitem)"


def _points(s, d):
    c = F.col
    return bridges.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").cast("bigint").alias("x"), (c("l_partkey") % 100).alias("y"), (c("l_suppkey") % 5 + 1).alias("w"))


_MOMENTS = {"sw": "w", "swx": "w * x", "swy": "w * y", "swxx": "w * x * x", "swxy": "w * x * y", "swyy": "w * y * y"}
_BY, _IN = ["l_orderkey"], ["l_linenumber", "x", "y", "w"]
_NUMBERED = f"{_LI}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, w) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM li)"
q(
    "prefix_moments",
    f"WITH {_NUMBERED} SELECT a.l_orderkey, a.l_linenumber, " + ", ".join(f"sum(b.{e.replace('* ', '* b.')})::BIGINT AS {n}" for n, e in _MOMENTS.items()) + " FROM r a JOIN r b ON b.l_orderkey = a.l_orderkey AND b.i <= a.i GROUP BY a.l_orderkey, a.l_linenumber, a.i",
    lambda s, d: moments.prefix_moments(_points(s, d), _BY, _IN).select("l_orderkey", "l_linenumber", *_MOMENTS),
)
q(
    "range_moments",
    f"WITH {_NUMBERED} SELECT a.l_orderkey, a.l_linenumber, " + ", ".join(f"sum(b.{e.replace('* ', '* b.')})::BIGINT AS {n}" for n, e in _MOMENTS.items()) + " FROM r a JOIN r b ON b.l_orderkey = a.l_orderkey AND b.i IN ((a.i + a.n - 1) % a.n, a.i, (a.i + 1) % a.n) WHERE a.n >= 3 GROUP BY a.l_orderkey, a.l_linenumber, a.i",
    lambda s, d: moments.range_moments(_points(s, d), _BY, _IN, 1).select("l_orderkey", "l_linenumber", *_MOMENTS),
)
# The error is the least eigenvalue: trace and determinant of the weighted covariance; the normal is checked by what it must give.
q(
    "line_fit",
    f"""WITH {_LI}, g AS (SELECT l_orderkey, sum(w)::DOUBLE AS sw, sum(w * x)::DOUBLE AS sx, sum(w * y)::DOUBLE AS sy FROM li GROUP BY l_orderkey),
v AS (SELECT li.l_orderkey, any_value(sx / sw) AS ex, any_value(sy / sw) AS ey, sum(w * (x - sx / sw) * (x - sx / sw)) / any_value(sw) AS cxx, sum(w * (x - sx / sw) * (y - sy / sw)) / any_value(sw) AS cxy, sum(w * (y - sy / sw) * (y - sy / sw)) / any_value(sw) AS cyy FROM li JOIN g USING (l_orderkey) GROUP BY li.l_orderkey),
e AS (SELECT *, (cxx + cyy) / 2 - sqrt(greatest(0, (cxx + cyy) * (cxx + cyy) / 4 - (cxx * cyy - cxy * cxy))) AS low FROM v)
SELECT l_orderkey, round(ex, 3) AS ex, round(ey, 3) AS ey, round(greatest(low, 0), 3) AS mse, abs(cxx + cyy - 2 * low) > 1e-6 AS has_normal FROM e""",
    lambda s, d: moments.cluster_lines(_points(s, d), _BY).select("l_orderkey", F.round("ex", 3).alias("ex"), F.round("ey", 3).alias("ey"), (F.round(F.greatest("mse", F.lit(0.0)), 3)).alias("mse"), (F.abs(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") - 1) < 1e-6).alias("has_normal")),
)
q(
    "slope_order",
    f"""WITH {_LI}, b AS (SELECT *, x - ((min(x) OVER g + max(x) OVER g) / 2.0 + 0.05118) AS dx, y - ((min(y) OVER g + max(y) OVER g) / 2.0 - 0.028581) AS dy FROM li WINDOW g AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY atan2(dy::DOUBLE, dx::DOUBLE), y, x, w, l_linenumber) AS place FROM b""",
    lambda s, d: moments.slope_key(_points(s, d), _BY).select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("slope_key", "y", "x", "w", "l_linenumber")).alias("place")),
)
_MAX = f"""{_NUMBERED}, mx AS (SELECT r.l_orderkey, r.l_linenumber, r.y FROM r JOIN r a ON a.l_orderkey = r.l_orderkey AND a.i = (r.i + r.n - 1) % r.n JOIN r b ON b.l_orderkey = r.l_orderkey AND b.i = (r.i + 1) % r.n WHERE r.y > a.y AND r.y > b.y)"""


def _maxima(s, d):
    return moments.local_maxima(_points(s, d), _BY, _IN, "y").select("l_orderkey", "l_linenumber", "y")


q("local_maxima", f"WITH {_MAX} SELECT * FROM mx", _maxima)
q(
    "topk_maxima",
    f"WITH {_MAX} SELECT l_orderkey, l_linenumber, y FROM mx m WHERE (SELECT count(*) FROM mx o WHERE o.l_orderkey = m.l_orderkey AND o.y >= m.y) <= 2",
    lambda s, d: moments.top_maxima(_maxima(s, d), _BY, "y", 2),
)

# Functions on columns, against SQL that states them another way.

_PT = "pt AS (SELECT c_custkey AS k, (c_custkey % 17 - 8)::DOUBLE AS x, (c_custkey % 23 - 11)::DOUBLE AS y, (c_custkey % 5 + 1)::DOUBLE AS u, (c_custkey % 7 - 3)::DOUBLE AS v, c_acctbal AS a FROM customer)"


def _pt(s, d):
    k = F.col("c_custkey")
    return bridges.table(s, d, "customer").select(k.alias("k"), (k % 17 - 8).cast("double").alias("x"), (k % 23 - 11).cast("double").alias("y"), (k % 5 + 1).cast("double").alias("u"), (k % 7 - 3).cast("double").alias("v"), F.col("c_acctbal").cast("double").alias("a"))


def f(name: str, sql: str, make) -> None:
    """A query of the point table: ``make(x, y, u, v, a)`` gives columns, which are rounded; ``sql`` selects the same."""
    SQL[name] = f"WITH {_PT} {sql}"

    def run(s, d):
        made = make(*(F.col(n) for n in "xyuva"))
        return _pt(s, d).select("k", *[(F.round(e, 4) + F.lit(0.0) if n != "inside" else e).alias(n) for n, e in made.items()])

    QUERIES[name] = run


_r = lambda e, n: f"round({e}, 4) + 0.0::DOUBLE AS {n}"
f("mod2pi", f"SELECT k, {_r('CASE WHEN atan2(sin(z), cos(z)) < 0 THEN atan2(sin(z), cos(z)) + 2 * pi() ELSE atan2(sin(z), cos(z)) END', 'pos')}, {_r('atan2(sin(z), cos(z))', 'mid')} FROM (SELECT k, x * 1.3 + y * 0.7 + 0.1 AS z FROM pt)", lambda x, y, u, v, a: {"pos": cols.mod2pi_pos(x * 1.3 + y * 0.7 + 0.1), "mid": cols.mod2pi(x * 1.3 + y * 0.7 + 0.1)})
_CUBIC = lambda x: [F.lit(0.5), F.lit(-1.0), x, F.lit(2.0)]
f("poly_eval", f"SELECT k, {_r('0.5 - v + x * pow(v, 2) + 2 * pow(v, 3)', 'p')}, {_r('-1 + 2 * x * v + 6 * pow(v, 2)', 'dp')} FROM pt", lambda x, y, u, v, a: {"p": cols.poly(_CUBIC(x), v), "dp": cols.poly(cols.poly_derivative(_CUBIC(x)), v)})
f("geom_distance", f"SELECT k, {_r('pow(pow(x - u, 2) + pow(y - v, 2), 0.5)', 'dist')}, {_r('CASE WHEN x = u AND y = v THEN 0 WHEN x = u THEN CASE WHEN v > y THEN pi() / 2 ELSE -pi() / 2 END ELSE atan((v - y) / (u - x)) + CASE WHEN u > x THEN 0 WHEN v >= y THEN pi() ELSE -pi() END END', 'angle')} FROM pt", lambda x, y, u, v, a: {"dist": cols.distance((x, y), (u, v)), "angle": cols.angle((x, y), (u, v))})


def _meeting(op):
    return lambda x, y, u, v, a: dict(zip(("ix", "iy"), op((x, y), (u, v), (F.lit(0.0), F.lit(5.0)), (F.lit(3.0), F.lit(-4.0))), strict=True))


# The given line is 9 x + 3 y = 15; the other one (v - y) x - (u - x) y = (v - y) x0 - (u - x) y0.
_MEET = "SELECT k, x, y, u, v, (v - y) AS p, (x - u) AS q, (v - y) * x + (x - u) * y AS r, 9 * (x - u) - 3 * (v - y) AS det FROM pt"
_HIT = "det <> 0 AND (x <> u OR y <> v)"
f("line_intersection", f"SELECT k, {_r(f'CASE WHEN {_HIT} THEN (15 * q - 3 * r) / det END', 'ix')}, {_r(f'CASE WHEN {_HIT} THEN (9 * r - 15 * p) / det END', 'iy')} FROM ({_MEET})", _meeting(cols.line_intersection))
f(
    "segment_intersection",
    f"""SELECT k, {_r('CASE WHEN ok THEN ix END', 'ix')}, {_r('CASE WHEN ok THEN iy END', 'iy')} FROM (SELECT *, ix BETWEEN -1e-9 AND 3 + 1e-9 AND iy BETWEEN -4 - 1e-9 AND 5 + 1e-9
  AND ix BETWEEN least(x, u) - 1e-9 AND greatest(x, u) + 1e-9 AND iy BETWEEN least(y, v) - 1e-9 AND greatest(y, v) + 1e-9 AS ok FROM (SELECT *, CASE WHEN {_HIT} THEN (15 * q - 3 * r) / det END AS ix, CASE WHEN {_HIT} THEN (9 * r - 15 * p) / det END AS iy FROM ({_MEET})))""",
    _meeting(cols.segment_intersection),
)
_NOTCHED = [(-7, -9), (6, -10), (7.5, 8.5), (0.5, 1.25), (-6.5, 9.5)]
_SIDES = ", ".join(f"({p[0]}::DOUBLE, {p[1]}::DOUBLE, {q_[0]}::DOUBLE, {q_[1]}::DOUBLE)" for p, q_ in zip(_NOTCHED, _NOTCHED[1:] + _NOTCHED[:1], strict=True))
f(
    "point_in_polygon",
    f"SELECT k, (sum(CASE WHEN (y0 > y) <> (y1 > y) AND sign(y1 - y0) * ((x - x0) * (y1 - y0) - (x1 - x0) * (y - y0)) < 0 THEN 1 ELSE 0 END) % 2 = 1) AS inside FROM pt, (VALUES {_SIDES}) e(x0, y0, x1, y1) GROUP BY k",
    lambda x, y, u, v, a: {"inside": cols.contains_point(cols.polygon(_NOTCHED), x, y)},
)
f("polygon_area", f"SELECT k, {_r('((u - x) * (4 - y) - (v - y)) / 2', 'area')} FROM pt", lambda x, y, u, v, a: {"area": cols.polygon_area(F.array(*[F.struct(p.alias("x"), q_.alias("y")) for p, q_ in ((x, y), (u, v), (x + 1, F.lit(4.0)))]))})
f("quad_rescale", f"SELECT k, {_r('2 * x - 0.5', 'x2')}, {_r('x + x / 2', 'x15')}, {_r('x', 'x0')} FROM pt", lambda x, y, u, v, a: {"x2": cols.rescale_corner(x, 2), "x15": cols.rescale_corner(x, 1.5), "x0": cols.rescale_corner(x, 0)})
f("clamp_saturate", f"SELECT k, {_r('CASE WHEN x < -5 THEN -5 WHEN x > 5 THEN 5 ELSE x END', 'clamped')}, {_r('CASE WHEN x > u THEN x - u ELSE 0 END', 'sat')} FROM pt", lambda x, y, u, v, a: {"clamped": cols.clamp(x, -5.0, 5.0), "sat": cols.saturating_sub(x, u)})
_named = lambda prefix, m: {f"{prefix}{i}{j}": v for i, r in enumerate(m.rows) for j, v in enumerate(r)}
_S3 = "x * v * 2 + y * floor(a) * 3 + u * (x - y) - 3 * v - 2 * u * y - x * (x - y) * floor(a)"  # the rule of Sarrus
f("matrix_det", f"SELECT k, {_r('x * v - y * u', 'd2')}, {_r(_S3, 'd3')} FROM pt", lambda x, y, u, v, a: {"d2": cols.Matrix([[x, y], [u, v]]).det(), "d3": cols.Matrix([[x, y, 1], [u, v, F.floor(a).cast("double")], [3, x - y, 2]]).det()})
f("matrix_inv", f"SELECT k, {_r('v / d', 'i00')}, {_r('-y / d', 'i01')}, {_r('-u / d', 'i10')}, {_r('x / d', 'i11')} FROM (SELECT *, nullif(x * v - y * u, 0) AS d FROM pt)", lambda x, y, u, v, a: _named("i", cols.Matrix([[x, y], [u, v]]).inverse()))
# Elimination by hand: the second row less half of the first, the third less 2/5 of the second.
f("matrix_solve", f"SELECT k, {_r('(u - s1) / 2', 's0')}, {_r('s1', 's1')}, {_r('s2', 's2')} FROM (SELECT *, (v - u / 2 - s2) / 2.5 AS s1 FROM (SELECT *, (y - (v - u / 2) / 2.5) / (x * x + 1.37 - 1 / 2.5) AS s2 FROM pt))", lambda x, y, u, v, a: {f"s{i}": e for i, e in enumerate(cols.Matrix([[2, 1, 0], [1, 3, 1], [0, 1, x * x + 1.37]]).solve([u, v, y]))})
f("matrix_matmul", f"SELECT k, {_r('x * u + y * v', 'm00')}, {_r('2 * x - y', 'm01')}, {_r('u * u + v * v', 'm10')}, {_r('2 * u - v', 'm11')} FROM pt", lambda x, y, u, v, a: _named("m", cols.Matrix([[x, y], [u, v]]) @ cols.Matrix([[u, 2], [v, -1]])))
f("matrix_transpose", f"SELECT k, {_r('x', 't00')}, {_r('u', 't01')}, {_r('y', 't10')}, {_r('v', 't11')}, {_r('1.0', 't20')}, {_r('2.0', 't21')} FROM pt", lambda x, y, u, v, a: _named("t", cols.Matrix([[x, y, 1], [u, v, 2]]).T))
f("vec_cross", f"SELECT k, {_r('2 * y - v', 'cx')}, {_r('u - 2 * x', 'cy')}, {_r('x * v - y * u', 'cz')} FROM pt", lambda x, y, u, v, a: dict(zip(("cx", "cy", "cz"), cols.cross([x, y, F.lit(1.0)], [u, v, F.lit(2.0)]), strict=True)))
f("vec_normalized", f"SELECT k, {_r('x * pow(x * x + y * y + u * u, -0.5)', 'nx')}, {_r('y * pow(x * x + y * y + u * u, -0.5)', 'ny')}, {_r('u * pow(x * x + y * y + u * u, -0.5)', 'nz')}, {_r('pow(pow(x - u, 2) + pow(y - v, 2), 0.5)', 'dist')} FROM pt", lambda x, y, u, v, a: dict(zip(("nx", "ny", "nz"), cols.normalized([x, y, u]), strict=True)) | {"dist": cols.vec_dist([x, y], [u, v])})
f("matrix_max_err", f"SELECT k, {_r('CASE WHEN abs(x - u) > abs(y - v) THEN abs(x - u) ELSE abs(y - v) END', 'err')}, {_r('list_max([x, y, u, v])', 'most')} FROM pt", lambda x, y, u, v, a: {"err": cols.Matrix([[x, y]]).err_inf(cols.Matrix([[u, v]])), "most": cols.Matrix([[x, y], [u, v]]).largest()})

# Poses of the scenes' markers.

CAMERA = Camera(tagsize=0.1, fx=600.0, fy=600.0, cx=50.0, cy=50.0)
#: In closed form: a border of 7 cells at a distance of f * size / side, its middle from the scene's margin, turned by quarters.
_POSED = """SELECT p_partkey AS image_id, (p_partkey % 35)::INT AS id, ((p_partkey % 7 % 4 + 2) % 4)::BIGINT AS quarter, round(z, 1) + 0.0::DOUBLE AS z, round((13 + p_partkey % 3 + 4.5 * sc - 50) / 600 * z, 2) + 0.0::DOUBLE AS x, round((13 + p_partkey % 2 + 4.5 * sc - 50) / 600 * z, 2) + 0.0::DOUBLE AS y{more}
FROM (SELECT *, 60.0::DOUBLE / (7 * sc) AS z FROM (SELECT p_partkey, [4, 5, 6, 7][p_partkey % 4 + 1] AS sc FROM part))"""


def _posed(found, *more):
    turn = F.round(F.atan2(F.col("r")[3], F.col("r")[0]) / (math.pi / 2)).cast("bigint")
    place = [(F.round(F.col("t")[i], n) + F.lit(0.0)).alias(a) for a, i, n in (("z", 2, 1), ("x", 0, 2), ("y", 1, 2))]
    return found.select("image_id", "id", ((turn + 4) % 4).alias("quarter"), *place, *more)


q("pose_homography", _POSED.format(more=""), lambda s, d: _posed(pose.with_pose(_detect(s, d), CAMERA, best_only=False, refine=False)))
q("pose_orthogonal", _POSED.format(more=", true AS exact, true AS facing"), lambda s, d: _posed(pose.with_pose(_detect(s, d), CAMERA), (F.col("error") < 1e-6).alias("exact"), (F.col("r")[8] > 0.99).alias("facing")))
q("pose_both_solutions", _POSED.format(more=", 0 AS solution, true AS exact"), lambda s, d: _posed(pose.with_pose(_detect(s, d), CAMERA, best_only=False).filter("solution = 0"), "solution", (F.col("error") < 1e-6).alias("exact")))
