"""Ranking, selection, splits, preference pairs and comparisons of contenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ready_for_checkpoints


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def best_of(rows: DataFrame, group: str, reward: str, index: str, creak: str | None = None, tie: float = 0.10, creak_from: float = 0.5) -> DataFrame:
    """One candidate of each group: failures (below 0) never; among those within ``tie`` of the best, least creak first."""
    ok = rows.filter(F.col(reward) >= 0)
    best = F.max(reward).over(Window.partitionBy(group))
    tied = ok.withColumn("_best", best).filter(F.col(reward) >= F.col("_best") - tie)
    heard = F.when(F.col(creak) >= creak_from, F.col(creak)).otherwise(0.0) if creak else F.lit(0.0)
    order = Window.partitionBy(group).orderBy(heard, F.desc(reward), index)
    return tied.withColumn("_at", F.row_number().over(order)).filter("_at = 1").drop("_at", "_best")


def preference_pairs(rows: DataFrame, group: str, reward: str, index: str, margin: float) -> DataFrame:
    """Best and worst candidate of each group where they differ by at least ``margin``."""
    worst = F.min(F.struct(reward, index))
    best = F.max(F.struct(F.col(reward), (-F.col(index)).alias("i")))
    pairs = rows.filter(F.col(reward) >= 0).groupBy(group).agg(best.alias("b"), worst.alias("w"))
    pairs = pairs.select(group, (-F.col("b.i")).alias("chosen"), F.col(f"w.{index}").alias("rejected"), F.col(f"b.{reward}").alias("reward_chosen"), F.col(f"w.{reward}").alias("reward_rejected"))
    return pairs.withColumn("margin", F.col("reward_chosen") - F.col("reward_rejected")).filter((F.col("margin") >= margin) & (F.col("chosen") != F.col("rejected")))


#: Rows that one task puts in order.
RANGE_ROWS = 500_000


def placed(rows: DataFrame, group: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with place (from 1, in ``order``) and of (the group's rows), whatever share of all rows a group has.

    Rows are dealt into sorted ranges of (group, order) and numbered in each; a range's numbers in a group go on from the
    counts of the ranges before, which are a row for each range and group. Ranges come from sampled bounds, so they are
    checkpointed before they are counted. Rows of equal group and order stay in one range.
    """
    ready_for_checkpoints(rows.sparkSession)
    keys = [F.col(g) for g in group]
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // range_rows)), *keys, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("of"))
    numbers = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return numbers.join(counts, same).select(*rows.columns, (F.col("place") + F.col("_before")).alias("place"), "of")


def split_rows(rows: DataFrame, group: list[str], key: Column, ratio: float, least: int, spare: int = 1) -> DataFrame:
    """Adds ``part``: of each group's rows in hash order, max(least, half-even round of n * ratio) are val; ``spare`` stay train."""
    known = placed(rows.withColumns({"_hash": F.md5(key.cast("string")), "_key": key}), group, ["_hash", "_key"])
    n = F.col("of")
    n_val = F.least(F.greatest(F.lit(least), F.bround(n * ratio).cast("int")), F.greatest(n - spare, F.lit(0)))
    return known.withColumn("part", F.when(F.col("place") <= n_val, "val").otherwise("train")).select(*rows.columns, "part")


def highest_share(rows: DataFrame, group: str, value: str, index: str, share: float = 0.1) -> DataFrame:
    """Adds ``held_out`` to each group's highest ``share`` by value, at least one row; null values come last."""
    known = placed(rows.withColumn("_low", -F.col(value)).withColumn("_none", F.col(value).isNull()), [group], ["_none", "_low", index])
    return known.withColumn("held_out", F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("of") * share))).select(*rows.columns, "held_out")


def balance_copies(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of rare classes again, up to three more times: half-even round of upper median over count, less one."""
    counts = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sorted(r["_n"] for r in counts.select("_n").collect())  # one number for each class
    middle = sizes[len(sizes) // 2] if sizes else 1
    extra = F.least(F.lit(3), F.greatest(F.lit(0), F.bround(F.lit(float(middle)) / F.col("_n")).cast("int") - 1))
    return rows.join(counts, kind).withColumn("copy", F.explode(F.sequence(F.lit(0), extra))).drop("_n")


def weighted_score(terms: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the terms that are there."""
    up = sum((F.when(t.isNotNull(), t * w).otherwise(0.0) for t, w in terms), F.lit(0.0))
    down = sum((F.when(t.isNotNull(), F.lit(w)).otherwise(0.0) for t, w in terms), F.lit(0.0))
    return F.when(down > 0, up / down)


def compare(a: DataFrame, b: DataFrame, key: str, value: str, dead: float = 0.01) -> DataFrame:
    """One row: samples that both have, means, mean difference b - a, wins, losses and ties of b."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).withColumn("d", F.col("b") - F.col("a"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 4).alias("mean_a"), F.round(F.avg("b"), 4).alias("mean_b"), F.round(F.avg("d"), 4).alias("mean_delta"),
        F.count_if(F.col("d") > dead).alias("wins"), F.count_if(F.col("d") < -dead).alias("losses"), F.count_if(F.abs("d") <= dead).alias("ties"),
    )
