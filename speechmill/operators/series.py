"""Ordered series: islands, silences, smoothing, stopping rules, interval suppression and loudness figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_adjacent(rows: DataFrame, group: str, start: str, end: str, label: str, gap: float, touching: bool = False) -> DataFrame:
    """Neighbouring intervals of one label, less than ``gap`` apart, as one: group, label, start, end, n.

    An interval joins the run before it if it begins before the furthest end of that run plus ``gap``, so overlaps and
    intervals inside others join too. With ``touching`` it joins only if its start is within ``gap`` of the end just
    before it, on either side, as words of a transcript do.
    """
    order = Window.partitionBy(group).orderBy(start, end, label)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_new", F.coalesce(F.lag(label).over(order) != F.col(label), F.lit(True)).cast("int")).withColumn("_stretch", F.sum("_new").over(so_far))
    inside = Window.partitionBy(group, "_stretch").orderBy(start, end)
    if touching:
        apart = F.abs(F.col(start) - F.lag(end).over(inside)) >= gap
    else:
        apart = F.col(start) - F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)) >= gap
    rows = rows.withColumn("_cut", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("_run", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(group, "_stretch", "_run", label).agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_stretch", "_run")


def quiet_runs(rows: DataFrame, group: str, index: str, value: str, below: float, least: int) -> DataFrame:
    """Maximal runs of at least ``least`` neighbouring rows under a level."""
    order = Window.partitionBy(group).orderBy(index)
    marked = rows.withColumns({"_pos": F.row_number().over(order), "_quiet": F.col(value) < below}).filter("_quiet")
    marked = marked.withColumn("_run", F.col("_pos") - F.row_number().over(order))
    runs = marked.groupBy(group, "_run").agg(F.min("_pos").alias("first"), F.count(F.lit(1)).alias("length"))
    return runs.filter(F.col("length") >= least).select(group, "first", "length")


def in_order(rows: DataFrame, group: str, order: list[str], value: str, name: str = "values") -> DataFrame:
    """Each group's values as an array in order; a group is one series, as long as its item lasted."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_s")).select(group, F.transform("_s", lambda s: s[value]).alias(name))


def step_limited(values: Column, step: float, anchor: Column | None = None) -> Column:
    """Values that move by at most ``step`` from one to the next; the first is the anchor, or the mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    first = F.array((mean if anchor is None else anchor).cast("double"))
    follow = lambda acc, t: F.array_append(acc, F.least(F.greatest(t, F.element_at(acc, -1) - step), F.element_at(acc, -1) + step))
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), first, follow)).otherwise(values)


def early_stop(values: Column, patience: int, min_delta: float) -> Column:
    """struct(best, best_at, stopped_at): positions from 0; stopped_at is null if no ``patience`` values in a row fail to improve."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(-1).alias("best_at"), F.lit(0).alias("bad"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("stopped_at"))

    def step(a: Column, v: Column) -> Column:
        better = a["best"].isNull() | (v < a["best"] - min_delta)
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        after = F.struct(F.when(better, v).otherwise(a["best"]).alias("best"), F.when(better, a["at"]).otherwise(a["best_at"]).alias("best_at"), bad.alias("bad"), (a["at"] + 1).alias("at"), F.when(bad >= patience, a["at"]).alias("stopped_at"))
        return F.when(a["stopped_at"].isNotNull(), a).otherwise(after)

    return F.aggregate(values, start, step, lambda a: F.struct(a["best"].alias("best"), a["best_at"].alias("best_at"), a["stopped_at"].alias("stopped_at")))


def suppress_overlaps(rows: DataFrame, group: str, start: str, end: str, score: str, share: float, most: int) -> DataFrame:
    """Best intervals first; one that overlaps a kept one by more than ``share`` of itself goes. ``most`` are kept in a group."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([score, start, end], ascending=[False, True, True], kind="stable")
        kept: list[int] = []
        bounds: list[tuple[float, float]] = []
        for i, (a, b) in enumerate(zip(frame[start], frame[end], strict=True)):
            if len(kept) == most:
                break
            if all(min(b, d) - max(a, c) <= share * (b - a) for c, d in bounds):
                kept.append(i)
                bounds.append((a, b))
        return frame.iloc[kept]

    return rows.groupBy(group).applyInPandas(keep, rows.schema)


def loudness_figures(rows: DataFrame, group: str, level: str, target: float = -20.0, boost: float = 12.0, cut: float = 15.0, silent: float = -100.0, digits: int = 2) -> DataFrame:
    """Median, quantiles, population deviation and the gain that brings the median to the target; groups of three or more."""
    heard = rows.filter(F.col(level) > silent)
    points = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    figures = heard.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(level, F.lit(p)).alias(k) for k, p in points.items()], F.stddev_pop(level).alias("std")).filter("n >= 3")
    gain = F.least(F.greatest(F.lit(target) - F.col("median"), F.lit(-cut)), F.lit(boost))
    return figures.select(group, "n", *[F.round(k, digits).alias(k) for k in points], F.round("std", digits).alias("std"), F.round(gain, digits).alias("gain"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the last right row at or before it, null if that row's is: one sort of both, no range join."""
    held = F.struct(F.col(value).alias("v"))  # a struct is there even if its value is null, so a matched null isn't passed over
    b = right.select(*keys, F.col(right_at).alias("_at"), held.alias("_v"), F.lit(0).alias("_side"))
    a = left.select("*", F.col(left_at).alias("_at"), F.lit(None).cast(b.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(order))
    return both.filter("_side = 1").withColumn(value, F.col("_v.v")).drop("_at", "_v", "_side")
