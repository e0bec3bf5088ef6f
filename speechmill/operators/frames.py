"""Frame series as tables (item, pos, hz; 0 is unvoiced): statistics, alignment, scores, intervals on frames.

A series is grouped by its item; statistics combine before the shuffle, except for exact percentiles, which keep an
item's distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from . import scans


def pitch_stats(frames: DataFrame) -> DataFrame:
    """item, n, voiced_ratio, median and std_st (semitones) of the voiced frames; items without any are left out."""
    voiced = F.col("hz") > 0
    stats = frames.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.avg(voiced.cast("double")).alias("voiced_ratio"), F.percentile(F.when(voiced, F.col("hz")), F.lit(0.5)).alias("median"),
        F.stddev_pop(F.when(voiced, 12 * F.log2("hz"))).alias("std_st"),
    )
    return stats.filter("median is not null")


def pitch_fingerprint(stats: DataFrame, least: int = 3) -> DataFrame:
    """One row over items: median of medians, mean spread, 10th and 90th percentile of medians; none for few items."""
    q = lambda p: F.percentile("median", F.lit(p))
    return stats.agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("median"), F.avg("std_st").alias("std_st"), q(0.1).alias("p10"), q(0.9).alias("p90")).filter(F.col("n") >= least)


def contour_agreement(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Of rows (pair, a, b: pitches of one frame): r, octave_errors, n_voiced.

    b is moved by the whole octaves nearest to the median distance; an error is a frame over 600 cents apart after that.
    """
    both = pairs.filter("a > 0 and b > 0").select("pair", F.log2("a").alias("la"), F.log2("b").alias("lb"))
    octaves = both.groupBy("pair").agg(F.rint(F.percentile(F.col("la") - F.col("lb"), F.lit(0.5))).alias("octaves"))
    moved = both.join(octaves, "pair")
    apart = F.abs(1200 * (F.col("la") - F.col("lb") - F.col("octaves"))) > 600
    out = moved.groupBy("pair").agg(F.corr("la", "lb").alias("r"), F.avg(apart.cast("double")).alias("octave_errors"), F.count(F.lit(1)).alias("n_voiced"))
    few = F.col("n_voiced") < least
    return out.select("pair", F.when(few, 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r"), F.when(few, 1.0).otherwise(F.col("octave_errors")).alias("octave_errors"), "n_voiced")


def share_above(frames: DataFrame, threshold: float) -> DataFrame:
    """item, share of the voiced frames above ``threshold``, and their mean."""
    voiced = frames.filter("hz > 0")
    high = F.col("hz") > threshold
    return voiced.groupBy("item").agg(F.avg(high.cast("double")).alias("share"), F.avg(F.when(high, F.col("hz"))).alias("mean_high"))


def segment_medians(frames: DataFrame, size: int) -> DataFrame:
    """item, segment, median of the voiced frames in tumbling segments of ``size`` frames."""
    segment = F.floor(F.col("pos") / size).alias("segment")
    return frames.filter("hz > 0").groupBy("item", segment).agg(F.percentile("hz", F.lit(0.5)).alias("median"))


def key_shift(frames: DataFrame, ceiling: float, least: int = 10) -> DataFrame:
    """item, semis: whole semitones down, 12 at most, that bring the 99th percentile under ``ceiling``; 0 for few frames."""
    top = frames.filter("hz > 0").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.percentile("hz", F.lit(0.99)).alias("p99"))
    semis = -F.ceil(12 * F.log2(F.col("p99") / ceiling))
    return top.select("item", F.when((F.col("n") < least) | (F.col("p99") <= ceiling), 0).otherwise(F.greatest(F.lit(-12), semis)).cast("int").alias("semis"))


def octave_map(source: Column, target: Column, manual: int | None = None) -> Column:
    """Semitones, in whole octaves, from one median pitch to another; 0 within 800 cents or without a pitch."""
    if manual is not None:
        return F.lit(max(-24, min(24, manual)))
    cents = 1200 * F.log2(target / source)
    none = (source <= 0) | (target <= 0) | source.isNull() | target.isNull()
    return F.when(none | (F.abs(cents) <= 800), 0).otherwise((F.rint(cents / 1200) * 12).cast("int"))


def shift_pitch(hz: Column, semis: float) -> Column:
    """``hz`` moved by semitones; unvoiced frames stay."""
    return F.when(hz > 0, hz * F.pow(F.lit(2.0), F.lit(semis / 12))).otherwise(hz)


def rms_dbfs(values: Column) -> Column:
    """Aggregate: level of the values' root mean square in dB, -120 for silence."""
    rms = F.sqrt(F.avg(values * values))
    return F.when(rms < 1e-10, -120.0).otherwise(20 * F.log10(rms))


def quantiles(frames: DataFrame, value: str, share: float) -> DataFrame:
    """item, n, quantile of the item's values but nulls, from running counts of its distinct values; no item is held whole."""
    counts = frames.filter(F.col(value).isNotNull()).groupBy("item", F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    item = Window.partitionBy("item")
    counts = counts.withColumns({"_to": F.sum("_c").over(item.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_c").over(item)})
    at = (F.col("n") - 1) * F.lit(share)
    reach = lambda k: F.min(F.when(F.col("_to") > k, F.col("_v")))
    ends = counts.withColumn("_at", at).groupBy("item").agg(F.first("n").alias("n"), F.first("_at").alias("_at"), reach(F.floor("_at")).alias("_lo"), reach(F.ceil("_at")).alias("_hi"))
    return ends.select("item", "n", numeric.between(F.col("_lo"), F.col("_hi"), F.col("_at") - F.floor("_at")).alias("quantile"))


def pause_score(frames: DataFrame, level: str) -> DataFrame:
    """item, score 0 to 1 of the share of silence between the first and last loud frame: 1 from 5 to 20 percent.

    Silence is at most twice the 10th percentile. Items of fewer than 4 frames, or of fewer than 2 loud ones, score 0.5.
    """
    known = frames.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    quiet = known.join(quantiles(frames, level, 0.1).drop("n"), "item", "left").select("item", "n", F.greatest(F.col("quantile") * 2, F.lit(1e-4)).alias("limit"))
    marked = frames.join(quiet, "item").withColumn("loud", F.col(level) > F.col("limit"))
    ends = marked.groupBy("item").agg(F.min(F.when(F.col("loud"), F.col("pos"))).alias("first"), F.max(F.when(F.col("loud"), F.col("pos"))).alias("last"), F.count_if("loud").alias("n_loud"), F.first("n").alias("n"))
    # All quiet frames less those before the first and after the last loud one.
    core = marked.join(ends.select("item", "first", "last"), "item").filter("pos between first and last").groupBy("item").agg(F.avg((~F.col("loud")).cast("double")).alias("ratio"))
    ratio = F.col("ratio")
    score = F.when((F.col("n") < 4) | (F.col("n_loud") < 2), 0.5).when(ratio.between(0.05, 0.20), 1.0).when(ratio < 0.05, ratio / 0.05).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 0.20) / 0.20))
    return ends.join(core, "item", "left").select("item", score.alias("score"))


def plateau_onset(history: DataFrame, eps: float) -> DataFrame:
    """item, step, still_dropping of rows (item, step, loss): where two slopes in a row, over two points each, are flat."""
    order = Window.partitionBy("item").orderBy("step")
    points = history.filter("loss is not null").select("*", F.lag("step", 2).over(order).alias("_s"), F.lag("loss", 2).over(order).alias("_l"))
    slope = F.coalesce((F.col("loss") - F.col("_l")) / F.nullif(F.col("step") - F.col("_s"), F.lit(0)), F.lit(0.0))
    flat = F.col("_s").isNotNull() & (F.abs(slope) < eps)
    points = points.withColumn("_flat", flat).withColumn("_on", F.col("_flat") & F.coalesce(F.lead("_flat").over(order), F.lit(False)))
    found = points.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last"), F.min(F.when(F.col("_on"), F.col("step"))).alias("on"))
    known = (F.col("n") >= 4) & F.col("on").isNotNull()
    return found.select("item", F.when(known, F.col("on")).otherwise(F.col("last")).alias("step"), (~known).alias("still_dropping"))


def frames_of_intervals(intervals: DataFrame) -> DataFrame:
    """item, pos, label of rows (item, seq, first, length, label): each frame in an interval; the later interval wins."""
    frames = intervals.filter("length > 0").select("item", "seq", "label", F.explode(F.expr("sequence(first, first + length - 1)")).alias("pos"))
    return frames.groupBy("item", "pos").agg(F.max_by("label", "seq").alias("label"))


def pick_apart(pieces: DataFrame, most: int, tolerance: float = 0.05) -> DataFrame:
    """Rows (item, start, end) taken in order of start where they begin at the last taken end or later, ``most`` at most."""
    return scans.picked_apart(pieces.select("item", "start", "end"), "item", "start", "end", tolerance, most).select("item", "start", "end")


def nearest_unused(wanted: DataFrame, there: DataFrame, within: float) -> DataFrame:
    """Each wanted time (item, seq, at), in order, with the nearest silence (item, start) not used yet within reach.

    The candidates come from an equi-join on bins as wide as the reach: a silence stands in its bin and both beside
    it, so only what is near meets. The greedy choice folds an item's candidates in order of the wants.
    """
    bin_of = lambda at: F.floor(at / within)
    asked = wanted.select("item", "seq", "at", bin_of(F.col("at")).alias("_bin"))
    offered = there.select(F.col("item").alias("_of"), "start", F.explode(F.sequence(bin_of(F.col("start")) - 1, bin_of(F.col("start")) + 1)).alias("_near"))
    near = asked.join(offered, (F.col("item") == F.col("_of")) & (F.col("_bin") == F.col("_near"))).filter(F.abs(F.col("start") - F.col("at")) <= within)
    near = near.select("item", "seq", F.abs(F.col("start") - F.col("at")).alias("apart"), "start")
    series = near.groupBy("item", "seq").agg(F.array_sort(F.collect_list(F.struct("apart", "start"))).alias("c")).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("seq", "c"))).alias("s"))
    none = F.array().cast("array<struct<seq:bigint,start:double>>")

    def take(acc: Column, want: Column) -> Column:
        free = F.filter(want["c"], lambda c: ~F.exists(acc, lambda u: u["start"] == c["start"]))
        return F.when(F.size(free) > 0, F.array_append(acc, F.struct(want["seq"].cast("bigint").alias("seq"), free[0]["start"].alias("start")))).otherwise(acc)

    return series.select("item", F.explode(F.aggregate("s", none, take)).alias("p")).select("item", "p.seq", "p.start")


def level_health(frames: DataFrame, voiced_db: float = 35.0, hop_seconds: float = 0.01) -> DataFrame:
    """Of rows (item, pos, db): silence_ratio, dynamic_range_db, snr_db and the silence at both ends in seconds.

    A frame within ``voiced_db`` of its item's loudest is voiced; 60 dB where nothing else is there to compare with.
    Rows without an item or a level don't count.
    """
    levels = frames.filter("item is not null and db is not null").select("item", "pos", "db")
    whole = levels.groupBy("item").agg(F.max("db").alias("top"), F.min("db").alias("low"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    voiced = F.col("db") >= F.col("top") - voiced_db
    told = levels.join(whole, "item").groupBy("item", "top", "low", "first", "last").agg(
        F.avg(voiced.cast("double")).alias("share"),
        F.avg(F.when(voiced, F.col("db"))).alias("speech"),
        F.avg(F.when(~voiced, F.col("db"))).alias("noise"),
        F.min(F.when(voiced, F.col("pos"))).alias("from"),
        F.max(F.when(voiced, F.col("pos"))).alias("to"),
    )
    return told.select(
        "item",
        (1 - F.col("share")).alias("silence_ratio"),
        (F.col("top") - F.col("low")).alias("dynamic_range_db"),
        F.coalesce(F.col("speech") - F.col("noise"), F.lit(60.0)).alias("snr_db"),
        ((F.col("from") - F.col("first")) * hop_seconds).alias("leading_silence"),
        ((F.col("last") - F.col("to")) * hop_seconds).alias("trailing_silence"),
    )
