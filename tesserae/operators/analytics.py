"""Operators over stage timings and nested benchmark records.

Timings are long rows: label, image_id, iter, seq, stage, wall, cpu.  Three standard deviations occur, each under its own name:
root mean square, population, and sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITERATION = ("label", "image_id", "iter")


def c(name: str) -> Column:
    return F.col(name)


def r6(e: Column) -> Column:
    return F.round(e, 6)


def stage_durations(stamps: DataFrame, keys=ITERATION, start: str | None = None) -> DataFrame:
    """Duration of a stamp: from the one before; the first from ``start`` (0 without it). cpu_duration skips stamps without CPU time."""
    w = Window.partitionBy(*keys).orderBy("seq")
    first = c(start) if start else F.lit(0)
    before_cpu = F.last("cpu", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return stamps.withColumns({
        "duration": c("wall") - F.coalesce(F.lag("wall").over(w), first),
        "cpu_duration": F.when(c("cpu").isNotNull(), c("cpu") - F.coalesce(before_cpu, F.lit(0))),
    })


def cumulative(durations: DataFrame, keys=ITERATION) -> DataFrame:
    """Running total and its share of the whole; the share of a whole of 0 is that of IEEE 754: infinite with the total's sign, or NaN."""
    w = Window.partitionBy(*keys).orderBy("seq")
    total = F.sum("wall").over(Window.partitionBy(*keys))
    run = F.sum("wall").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    of_none = F.when(run == 0, float("nan")).when(run > 0, float("inf")).when(run < 0, float("-inf"))
    return durations.withColumns({"cumulative": run, "pct": F.when(total == 0, of_none).otherwise(r6(run * 100 / F.when(total != 0, total)))})


def total_duration(stamps: DataFrame, keys=ITERATION) -> DataFrame:
    """From the first stamp to the last."""
    return stamps.groupBy(*keys).agg((F.max("wall") - F.min("wall")).alias("total"))


def rms(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def profile_statistics(rows: DataFrame, keys=("stage",)) -> DataFrame:
    """Mean, least, largest, and root mean square."""
    v = c("wall").cast("double")
    return rows.groupBy(*keys).agg(r6(F.avg(v)).alias("mean"), F.min("wall").alias("least"), F.max("wall").alias("most"), r6(rms(v)).alias("rms"))


def summary_statistics(rows: DataFrame, keys) -> DataFrame:
    """Mean, least, largest and population standard deviation; 0 where there is nothing."""
    zero = lambda e: F.coalesce(e, F.lit(0))
    return rows.groupBy(*keys).agg(zero(r6(F.avg("wall"))).alias("mean"), zero(F.min("wall")).alias("least"), zero(F.max("wall")).alias("most"), zero(r6(F.stddev_pop("wall"))).alias("std_pop"))


def stage_means(rows: DataFrame, keys=("label",), value: str = "wall") -> DataFrame:
    """Mean per stage and the place where a stage is first seen."""
    return rows.groupBy(*keys, "stage").agg(r6(F.avg(value)).alias("mean"), F.min(F.struct("iter", "seq"))["seq"].alias("first_seq"))


def without_warm_up(rows: DataFrame, warm_up: int) -> DataFrame:
    return rows.filter(c("iter") >= warm_up)


def last_count(rows: DataFrame, keys=("label", "image_id")) -> DataFrame:
    """Rows of each image's last iteration."""
    counts = rows.groupBy(*keys, "iter").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("n", "iter").alias("detection_count"))


def hamming_histogram(detections: DataFrame, group: str) -> DataFrame:
    """Detections by Hamming distance, of each group and of all (group null)."""
    per = detections.groupBy(group, "hamming").agg(F.count(F.lit(1)).alias("n"))  # combined before the roll-up
    return per.rollup("hamming", group).agg(F.sum("n").alias("n")).filter("hamming IS NOT NULL")


def run_overview(rows: DataFrame, key: str = "label") -> DataFrame:
    return rows.groupBy(key).agg(F.min("stage").alias("first_stage"), F.countDistinct("image_id").alias("images"), r6(F.avg("wall")).alias("mean"), r6(F.stddev_samp("wall")).alias("std_samp"))


def stage_table(rows: DataFrame) -> DataFrame:
    """Per run and stage: mean and sample deviation of known values, share of the run's stage means, and whether the run is the stage's best."""
    m = rows.groupBy("label", "stage").agg(F.avg("wall").alias("m"), F.stddev_samp("wall").alias("s"))
    share = c("m") * 100 / F.sum("m").over(Window.partitionBy("label"))
    best = c("m") == F.min("m").over(Window.partitionBy("stage"))
    return m.select("label", "stage", r6(c("m")).alias("mean"), r6(c("s")).alias("std_samp"), r6(share).alias("pct"), best.alias("best"))


def filled_means(rows: DataFrame, value: str = "cpu") -> DataFrame:
    """Stage means that take a missing value as 0."""
    return rows.groupBy("label", "stage").agg(r6(F.avg(F.coalesce(c(value), F.lit(0)))).alias("mean"))


def stage_percent(rows: DataFrame) -> DataFrame:
    """Mean of a stage over the mean of all rows of its run."""
    m = rows.groupBy("label", "stage").agg(F.sum("wall").alias("s"), F.count("wall").alias("n"))
    w = Window.partitionBy("label")
    return m.select("label", "stage", r6((c("s") / c("n")) * 100 / (F.sum("s").over(w) / F.sum("n").over(w))).alias("pct"))


def known_stages(rows: DataFrame, value: str = "cpu") -> DataFrame:
    """Means of the stages that have a value at all in some run."""
    m = rows.groupBy("label", "stage").agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    m = m.withColumn("known", F.sum("n").over(Window.partitionBy("stage")))
    return m.filter("known > 0 AND n > 0").select("label", "stage", r6(c("m")).alias("mean"))


def base_label(label: Column, number: Column, accelerator: Column, threads: Column) -> Column:
    """A run's label, or a made-up one."""
    return F.coalesce(label, F.format_string("run-%d (%s, %dt)", number, accelerator, threads))


def distinct_labels(runs: DataFrame, label: str, stamp: str) -> DataFrame:
    """Labels that occur more than once get their time to the second."""
    many = F.count(F.lit(1)).over(Window.partitionBy(label)) > 1
    shown = F.concat(c(label), F.lit(" ("), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit(")"))
    return runs.withColumn("shown", F.when(many, shown).otherwise(c(label)))


def profile_lines(runs: DataFrame, short: bool = False) -> DataFrame:
    """``runs`` with a line of text for each time stamp: number, stage, milliseconds and share of the run's last stamp; or stage and microseconds."""
    if short:
        return runs.withColumn("line", F.format_string("%s: %d us", "stage", "wall"))
    total = F.max("wall").over(Window.partitionBy("label", "image_id", "iter"))
    tenths = F.when(total > 0, F.floor(c("wall") * 1000 / total)).otherwise(0)  # of a percent, cut off
    return runs.withColumn("line", F.format_string("%2d %-32s%15.3f%5d.%d %%", "seq", "stage", c("wall") / 1e3, F.floor(tenths / 10), tenths % 10))


def pairwise_welch(rows: DataFrame, key: str = "label", by: str | None = None) -> DataFrame:
    """All pairs of runs, first key before second: means, population deviations, difference in percent, t and degrees of freedom.

    With ``by`` (such as the stage) each of its values has its pairs. Only one row a run and value meets another, after aggregation.
    """
    own = [by] if by else []
    return _welch(rows.groupBy(*own, key), key, own)


def _welch(groups, key: str, by: list[str]) -> DataFrame:
    a = groups.agg(F.count("wall").alias("n"), F.avg("wall").alias("m"), F.stddev_pop("wall").alias("sp"), F.var_samp("wall").alias("v"))
    b = a.select(*by, *[c(n).alias(f"{n}_b") for n in (key, "n", "m", "sp", "v")])
    p = a.join(b, by) if by else a.join(b, c(key) < c(f"{key}_b"))
    p = p.filter(c(key) < c(f"{key}_b"))
    ea, eb = c("v") / c("n"), c("v_b") / c("n_b")
    t = F.when(ea + eb > 0, (c("m") - c("m_b")) / F.sqrt(ea + eb))
    df = F.when((c("n") > 1) & (c("n_b") > 1) & (ea + eb > 0), (ea + eb) * (ea + eb) / (ea * ea / (c("n") - 1) + eb * eb / (c("n_b") - 1)))
    diff = F.when(c("m") != 0, (c("m_b") - c("m")) / c("m") * 100).otherwise(0.0)
    return p.select(*by, c(key).alias("run_a"), c(f"{key}_b").alias("run_b"), r6(c("m")).alias("mean_a"), r6(c("sp")).alias("std_a"), r6(c("m_b")).alias("mean_b"), r6(c("sp_b")).alias("std_b"), r6(diff).alias("diff_pct"), r6(t).alias("t"), r6(df).alias("df"))


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function of arrays.

    Even and odd terms of its continued fraction are folded from the last one back; the side on which it
    converges fast is chosen by symmetry.
    """
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    known = np.isfinite(a + b + x)
    p, q, z = np.where(known, a, 1.0), np.where(known, b, 1.0), np.clip(np.where(known, x, 0.5), 0, 1)
    swap = z > (p + 1) / (p + q + 2)
    p, q, z = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - z, z)
    tail = np.ones_like(z)
    for k in range(300, 0, -1):
        even = k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k))
        odd = -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))
        tail = 1 + even / (1 + odd / tail)
    tail = 1 - (p + q) * z / (p + 1) / tail
    gamma = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    value = front / tail
    return np.where(known, np.where(swap, 1 - value, value), np.nan)


def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(incomplete_beta(df / 2, 0.5, df / (df + t * t))).fillna(1.0)


def with_p_value(pairs: DataFrame) -> DataFrame:
    """p (two-sided; 1 where there is no t) and stars at .05, .01 and .001."""
    p_of = F.pandas_udf(_p_value, "double")
    stars = F.when(c("p") < 0.001, "***").when(c("p") < 0.01, "**").when(c("p") < 0.05, "*").otherwise("")
    return pairs.withColumn("p", p_of("t", "df")).withColumn("stars", stars)


def histogram(rows: DataFrame, value: str, bins: int, group: str) -> DataFrame:
    """Counts in bins of equal width between each group's least and largest value; groups that hardly vary are left out."""
    span = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_pop(value).alias("sd")).filter("sd >= 0.001")
    at = F.least(F.floor((c(value) - c("lo")) * bins / (c("hi") - c("lo"))), F.lit(bins - 1))
    return rows.join(span, group).groupBy(group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def groupby_variables(rows: DataFrame, columns: list[str], forced: dict[str, str] | None = None) -> DataFrame:
    """Columns with two values or more, and whether they are discrete or continuous."""
    forced = forced or {}
    numeric = {n for n, t in rows.dtypes if t in ("bigint", "int", "double", "float", "smallint")}
    counts = rows.agg(*[F.countDistinct(n).alias(n) for n in columns])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), c(n).alias("n_values"), F.lit(forced.get(n)).cast("string").alias("f"), F.lit(n in numeric).alias("num")) for n in columns])).alias("s")).select("s.*")
    kind = F.coalesce("f", F.when(c("num") & (c("n_values") > 5), "continuous").otherwise("discrete"))
    return long.filter("n_values >= 2").select("variable", "n_values", kind.alias("kind"))


def discrete_chart(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(c(key).cast("string").alias("category")).agg(r6(F.avg("wall")).alias("mean"), r6(F.stddev_samp("wall")).alias("std_samp"))


def continuous_chart(rows: DataFrame, key: str, run: str = "label") -> DataFrame:
    return rows.groupBy(run, key).agg(r6(F.avg("wall")).alias("mean"), F.coalesce(r6(F.stddev_samp("wall")), F.lit(0.0)).alias("std"))


def with_prefix(rows: DataFrame, label: str, prefix: str) -> DataFrame:
    return rows.filter(c(label).startswith(prefix))


#: One run of a nested record.
RUN_SCHEMA = "label string, images array<struct<image_id: bigint, iterations: array<struct<iter: bigint, wall: bigint, stages: map<string, bigint>>>>>"


def to_records(rows: DataFrame) -> DataFrame:
    """One JSON document for each image of a run: label, the image, its iterations and their stages. No larger group meets in one task."""
    it = rows.groupBy("label", "image_id", "iter").agg(F.sum("wall").alias("wall"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("-", "stage", c("seq").cast("string")).alias("key"), c("wall").alias("value"))))).alias("stages"))
    im = it.groupBy("label", "image_id").agg(F.array_sort(F.collect_list(F.struct("iter", "wall", F.to_json("stages").alias("stages")))).alias("i"))
    im = im.select("label", "image_id", F.transform("i", lambda x: F.struct(x["iter"].alias("iter"), x["wall"].alias("wall"), F.from_json(x["stages"], "map<string,bigint>").alias("stages"))).alias("iterations"))
    return im.select(F.to_json(F.struct("label", F.array(F.struct("image_id", "iterations")).alias("images"))).alias("value"))


def from_records(text: DataFrame, column: str = "value") -> DataFrame:
    """label, image_id, iter, wall, stage, stage_wall; blank and malformed lines are left out."""
    runs = text.select(F.from_json(column, RUN_SCHEMA).alias("r")).filter("r.label IS NOT NULL").select("r.*")
    im = runs.select("label", F.explode("images").alias("im")).select("label", "im.image_id", F.explode("im.iterations").alias("it"))
    return im.select("label", "image_id", "it.iter", "it.wall", F.explode("it.stages").alias("stage", "stage_wall"))


def stage_order(rows: DataFrame) -> DataFrame:
    """Stages in the order of the first iteration that has them."""
    return rows.groupBy("label", "stage").agg(F.min_by("seq", F.struct("iter", "seq")).alias("place"))
