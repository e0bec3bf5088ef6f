"""Waves as arrays of samples, as column functions, and repairs of frame series (item, pos, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import once, sorted_quantile, total


def _doubles(wave: Column) -> Column:
    return F.transform(wave, lambda x: x.cast("double"))


def peak(wave: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(wave, lambda x: F.abs(x))), F.lit(0.0))


def level(wave: Column) -> Column:
    """Root mean square in dB, -120 for silence."""
    rms = F.sqrt(total(F.transform(wave, lambda x: x.cast("double") * x.cast("double"))) / F.size(wave))
    return F.when(rms < 1e-10, -120.0).otherwise(20 * F.log10(rms))


def under_ceiling(wave: Column, ceiling_db: float = -1.0) -> Column:
    """The wave, made quieter if its peak is above the ceiling."""
    limit = 10 ** (ceiling_db / 20)
    return once(wave, lambda w: once(peak(w), lambda top: F.when(top > limit, F.transform(w, lambda x: x * (limit / top))).otherwise(w)))


def _gained(wave: Column, db: Column, ceiling_db: float) -> Column:
    return once(F.pow(F.lit(10.0), db / 20), lambda gain: under_ceiling(F.transform(wave, lambda x: x.cast("double") * gain), ceiling_db))


def anchored(wave: Column, low_db: float, high_db: float, gain_db: float, ceiling_db: float = -1.0) -> Column:
    """A wave moved by the anchor's gain, its own level first brought within bounds; silence stays as it is."""
    moved = lambda now: _gained(wave, F.least(F.greatest(now, F.lit(low_db)), F.lit(high_db)) + gain_db - now, ceiling_db)
    return once(level(wave), lambda now: F.when(now <= -100.0, _doubles(wave)).otherwise(moved(now)))


def at_level(wave: Column, target_db: float, ceiling_db: float = -1.0) -> Column:
    """A wave at a root mean square, its peak under the ceiling."""
    return once(level(wave), lambda now: F.when(now <= -120.0, _doubles(wave)).otherwise(_gained(wave, F.lit(target_db) - now, ceiling_db)))


def trimmed(wave: Column, loud: float, margin: int) -> Column:
    """From ``margin`` samples before the first loud one to as many after the last; as it is without a loud one."""
    at = F.filter(F.transform(wave, lambda x, i: F.when(F.abs(x) >= loud, i)), lambda i: i.isNotNull())
    first = F.greatest(F.array_min(at) - margin, F.lit(0))
    last = F.least(F.array_max(at) + margin, F.size(wave) - 1)
    return F.when(F.size(at) > 0, F.slice(wave, first + 1, last - first + 1)).otherwise(wave)


def segment(wave: Column, first: int, end: int) -> Column:
    """Samples ``first`` to ``end`` (excluded); an error if that is not a range of the wave."""
    wrong = (F.lit(first) < 0) | (F.lit(end) <= first) | (F.lit(end) > F.size(wave))
    return F.when(wrong, F.raise_error(F.lit(f"no samples {first} to {end}")).cast("array<double>")).otherwise(F.slice(_doubles(wave), first + 1, end - first))


def crossfaded(a: Column, b: Column, overlap: int) -> Column:
    """b after a, ``overlap`` samples of both faded at equal power; joined without a fade where one is too short."""
    return once(_doubles(a), lambda a: once(_doubles(b), lambda b: _crossfaded(a, b, overlap)))


def _crossfaded(a: Column, b: Column, overlap: int) -> Column:
    turn = lambda i: F.when(F.lit(overlap) > 1, i / F.lit(float(max(overlap - 1, 1)))).otherwise(0.0) * (math.pi / 2)
    mixed = F.transform(F.sequence(F.lit(0), F.lit(max(overlap - 1, 0))), lambda i: F.get(a, F.size(a) - overlap + i) * F.cos(turn(i)) + F.get(b, i) * F.sin(turn(i)))
    faded = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - overlap, F.lit(0))), mixed, F.slice(b, F.lit(overlap + 1), F.greatest(F.size(b) - overlap, F.lit(0))))
    plain = (F.lit(overlap) <= 0) | (F.size(b) <= overlap) | (F.size(a) < overlap)
    return F.when(F.size(a) == 0, b).when(plain, F.concat(a, b)).otherwise(faded)


def with_silence_between(waves: Column, samples: int) -> Column:
    """One wave of several, with silence between, not after the last."""
    gap = F.array_repeat(F.lit(0.0), samples)
    return F.flatten(F.transform(waves, lambda w, i: F.when(i == 0, _doubles(w)).otherwise(F.concat(gap, _doubles(w)))))


def band_means(profiles: DataFrame, by: str, profile: str, least: int = 3) -> DataFrame:
    """by, band, mean of arrays of one width; groups of fewer than ``least`` are left out. Sums combine before the shuffle."""
    bands = profiles.select(by, F.posexplode(profile).alias("band", "_x")).groupBy(by, "band").agg(F.avg(F.col("_x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("_n"))
    return bands.filter(F.col("_n") >= least).drop("_n")


def pitch_rewards(pairs: DataFrame, hnr: str, singing: str) -> DataFrame:
    """pair, within, octave_errors, cents, reward of rows (pair, a: candidate's pitch, b: target's, hnr, singing).

    Frames within 50 cents and octave errors are counted after b moved by whole octaves; a median over 600 cents away
    without that costs 30. Pairs of fewer than five voiced frames have none within and only errors.
    """
    both = pairs.filter("a > 0 and b > 0").select("pair", (F.log2("a") - F.log2("b")).alias("d"))
    medians = both.groupBy("pair").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    apart = F.abs(1200 * (F.col("d") - F.rint("m")))
    counted = both.join(medians, "pair").groupBy("pair").agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m"), F.avg((apart <= 50).cast("double")).alias("w"), F.avg((apart > 600).cast("double")).alias("e"))
    sounds = pairs.groupBy("pair").agg(F.avg(hnr).alias("hnr"), F.avg(singing).alias("singing"))
    few = F.coalesce(F.col("k"), F.lit(0)) < 5
    rows = sounds.join(counted, "pair", "left").select("pair", "hnr", "singing", F.when(few, 0.0).otherwise(F.col("w")).alias("within"), F.when(few, 1.0).otherwise(F.col("e")).alias("octave_errors"), F.when(few, 0.0).otherwise(1200 * F.col("m")).alias("cents"))
    reward = F.greatest(F.coalesce("hnr", F.lit(0.0)), F.lit(0.0)) * 0.05 + 40 * (F.col("within") - F.col("octave_errors")) + 20 * F.coalesce("singing", F.lit(0.0)) - F.when(F.abs("cents") > 600, 30.0).otherwise(0.0)
    return rows.select("pair", "within", "octave_errors", "cents", reward.alias("reward"))


def smoothed(frames: DataFrame, least: int = 10) -> DataFrame:
    """Frames with the voiced pitches of an item as medians of five, then means of five.

    Medians repeat the end values beyond the ends, means take nothing there; an item of fewer voiced frames stays.
    """
    item = Window.partitionBy("item")
    order = item.orderBy("pos")
    near = order.rowsBetween(-2, 2)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    voiced = frames.filter("hz > 0")
    ends = F.first("hz").over(whole), F.last("hz").over(whole)
    five = F.array(*[F.coalesce(F.lag("hz", -k).over(order), ends[k > 0]) for k in range(-2, 3)])
    mean = F.sum(F.sort_array("_five")[2]).over(near) / 5
    done = voiced.withColumns({"_five": five, "_n": F.count(F.lit(1)).over(item)}).withColumn("hz", F.when(F.col("_n") >= least, mean).otherwise(F.col("hz"))).drop("_five", "_n")
    return done.unionByName(frames.filter("not hz > 0 or hz is null"))


def regridded(frames: DataFrame, lengths: DataFrame, voiced_share: float = 0.45) -> DataFrame:
    """item, place, hz: each item's pitches (pos 0 to n - 1) on a grid of as many places as ``lengths`` (item, places) says.

    Values between two frames are interpolated; where less than the share of the two is voiced, the place is unvoiced.
    Two equi-joins on (item, pos) fetch the neighbours.
    """
    voiced = (F.col("hz") > 0).cast("double")
    known = frames.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum(voiced).alias("v"))
    grid = lengths.filter("places > 0").join(known, "item").select("item", "n", "v", "places", F.explode(F.expr("sequence(0, places - 1)")).alias("place"))
    x = F.when(F.col("places") > 1, (F.col("place") * (F.col("n") - 1)).cast("double") / (F.col("places") - 1)).otherwise(0.0)
    grid = grid.withColumn("x", x).withColumn("lo", F.floor("x")).withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1)).withColumn("t", F.col("x") - F.col("lo"))
    side = lambda k: frames.select("item", F.col("pos").alias(k), F.col("hz").alias(f"hz_{k}"), voiced.alias(f"v_{k}"))
    both = grid.join(side("lo"), ["item", "lo"]).join(side("hi"), ["item", "hi"])
    mix = lambda c: F.col(f"{c}_lo") * (1 - F.col("t")) + F.col(f"{c}_hi") * F.col("t")
    return both.select("item", "place", F.when((F.col("v") > 2) & (mix("v") < voiced_share), 0.0).otherwise(mix("hz")).alias("hz"))


def shrink_silences(codes: DataFrame, silent: Column, keep: int = 10, least: int = 30) -> DataFrame:
    """Codes (item, pos, ...) without all but the first ``keep`` of each silent run, in items of more than ``least`` silent ones."""
    item = Window.partitionBy("item")
    order = item.orderBy("pos")
    marked = codes.withColumn("_s", F.coalesce(silent, F.lit(False)))
    marked = marked.withColumns({"_many": F.count_if("_s").over(item) > least, "_run": F.sum((~F.col("_s")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    place = F.row_number().over(Window.partitionBy("item", "_run", "_s").orderBy("pos"))
    return marked.withColumn("_k", place).filter(~F.col("_s") | ~F.col("_many") | (F.col("_k") <= keep)).drop("_s", "_many", "_run", "_k")


def edge_silences(frames: DataFrame, quiet: Column, most: int) -> DataFrame:
    """item, head, tail: quiet frames at both ends, ``most`` at most."""
    ends = frames.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.min(F.when(~quiet, F.col("pos"))).alias("first"), F.max(F.when(~quiet, F.col("pos"))).alias("last"))
    upto = lambda c: F.least(F.coalesce(c, F.col("n")), F.lit(most)).cast("int")
    return ends.select("item", upto(F.col("first") - F.col("a")).alias("head"), upto(F.col("b") - F.col("last")).alias("tail"))


def times_of_shares(frames: DataFrame, voiced: Column, shares: list[float]) -> DataFrame:
    """item, mark, pos: the first frame by which a share of the item's voiced frames, less a half, is past."""
    order = Window.partitionBy("item").orderBy("pos")
    run = frames.withColumns({"_c": F.sum(voiced.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(voiced.cast("int")).over(Window.partitionBy("item"))})
    hits = [F.min(F.when(F.col("_c") >= F.greatest(F.lit(0.0), F.lit(s) * F.col("_all") - 0.5), F.col("pos"))) for s in shares]
    marks = run.filter("_all > 0").groupBy("item").agg(F.array(*hits).alias("_h"))
    return marks.select("item", F.posexplode("_h").alias("mark", "pos"))


def tear_and_bursts(frames: DataFrame, active: Column, tear: Column, burst: Column, least: int = 4) -> DataFrame:
    """item, tear_pct of the active frames, gap_bursts: runs of at least ``least`` frames that burst."""
    order = Window.partitionBy("item").orderBy("pos")
    marked = frames.select("item", "pos", active.alias("_a"), tear.alias("_t"), burst.alias("_b")).withColumn("_run", F.sum((~F.col("_b")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("item", "_run").agg(F.count_if("_a").alias("a"), F.count_if(F.col("_a") & F.col("_t")).alias("t"), F.count_if("_b").alias("b"))
    share = F.coalesce(F.try_divide(F.sum("t") * 100.0, F.sum("a")), F.lit(0.0))
    return runs.groupBy("item").agg(F.round(share, 2).alias("tear_pct"), F.count_if(F.col("b") >= least).alias("gap_bursts"))


def frame_levels(wave: Column, width: int, hop: int) -> Column:
    """Level in dB of each frame of ``width`` samples, ``hop`` apart, -200 at least; a shorter wave is filled with zeros."""
    filled = F.concat(_doubles(wave), F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(wave), F.lit(0))))
    starts = lambda w: F.sequence(F.lit(0), F.floor((F.size(w) - width) / hop).cast("int"))
    rms = lambda w, k: F.sqrt(F.aggregate(F.slice(w, k * hop + 1, width), F.lit(0.0), lambda s, x: s + x * x) / width)
    return once(filled, lambda w: F.transform(starts(w), lambda k: 20 * F.log10(F.greatest(rms(w, k), F.lit(1e-10)))))


def inhales(frames: DataFrame, shortest: int = 8, longest: int = 30, ahead: int = 15, most: int = 6) -> DataFrame:
    """item, first, length, score: quiet, rough runs before speech, the best of each item.

    Frames (item, pos, rms, rough) are quiet under a quarter of the speech level, the median of those over the 60th
    percentile; ``ahead`` frames after a run must reach half of it. Ties: the earlier run.
    """
    order = Window.partitionBy("item").orderBy("pos")
    high = frames.groupBy("item").agg(F.percentile("rms", F.lit(0.6)).alias("_p"), F.percentile("rough", F.lit(0.5)).alias("_r"))
    speech = frames.join(high, "item").filter(F.col("rms") > F.col("_p")).groupBy("item").agg(F.percentile("rms", F.lit(0.5)).alias("_s"), F.first("_r").alias("_r")).filter("_s > 0")
    marked = frames.join(speech, "item").withColumns({"_q": (F.col("rms") < F.col("_s") * 0.25) & (F.col("rough") > F.col("_r")), "_a": F.max("rms").over(order.rowsBetween(1, ahead))})
    marked = marked.withColumn("_run", F.sum((~F.col("_q")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_q")
    runs = marked.groupBy("item", "_run").agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("length"), F.avg("rms").alias("m"), F.avg("rough").alias("r"), F.max_by("_a", "pos").alias("a"), F.first("_s").alias("s"), F.first("_r").alias("b"),
    )
    depth, air = 1 - F.col("m") / F.col("s"), F.col("r") / F.greatest("b", F.lit(1e-9))
    runs = runs.filter(F.col("length").between(shortest, longest) & (F.col("a") > F.col("s") * 0.5)).withColumn("score", F.round(F.least(F.lit(1.0), 0.6 * depth + 0.4 * air), 3))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "first"))
    return runs.withColumn("_k", best).filter(F.col("_k") <= most).select("item", "first", "length", "score")


def final_creak(frames: DataFrame, reach: int = 150, tail: int = 65, low: float = 0.62, least_ms: float = 30.0, frame_ms: float = 10.0, floor_db: float = -45.0, below_db: float = 24.0) -> DataFrame:
    """item, score 0 to 1 of how far and how long the pitch drops in the last ``tail`` frames.

    Of frames (item, pos, hz, db), the last ``reach`` of an item count; voiced ones above the gate are audible. Items of
    fewer than ten frames, or of fewer than five audible ones in all or in the tail, score 0.
    """
    ends = frames.groupBy("item").agg(F.max("pos").alias("_end"))
    near = frames.join(ends, "item").withColumn("_back", F.col("_end") - F.col("pos")).filter(F.col("_back") < reach)
    levels = near.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("db")).alias("_dbs"))  # ``reach`` of each item at most
    gates = levels.select("item", "n", F.greatest(F.lit(floor_db), sorted_quantile(F.col("_dbs"), 0.6) - below_db).alias("_gate"))
    heard = near.join(gates, "item").filter((F.col("hz") > 0) & (F.col("db") > F.col("_gate")))
    medians = heard.groupBy("item").agg(F.percentile("hz", F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    last = heard.filter(F.col("_back") < tail).join(medians, "item").groupBy("item").agg(
        F.first("_m").alias("m"), F.first("_n").alias("k"), F.count(F.lit(1)).alias("t"), (F.min("hz") / F.first("_m")).alias("ratio"), (F.count_if(F.col("hz") < F.col("_m") * low) * frame_ms).alias("ms"),
    )
    within = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    score = within((F.lit(low) - F.col("ratio")) / 0.32) * (0.5 + 0.5 * within(F.col("ms") / 150.0))
    known = (F.col("n") >= 10) & (F.col("k") >= 5) & (F.col("t") >= 5) & (F.col("ms") >= least_ms) & (F.col("ratio") < low)
    return gates.join(last, "item", "left").select("item", F.when(known, F.round(score, 3)).otherwise(0.0).alias("score"))


def wave_health(wave: Column, full_scale: float = 0.999) -> list[Column]:
    """peak_dbfs, rms_dbfs, clip_ratio and dc_offset of a wave; null for one without samples. Levels end at -200 dB."""
    sized = F.when(F.size(wave) > 0, wave)
    mean = lambda of: F.aggregate(sized, F.lit(0.0), lambda s, x: s + of(x.cast("double"))) / F.size(sized)
    level = lambda x: F.when(x.isNotNull(), 20 * F.log10(F.greatest(x, F.lit(1e-10))))
    return [
        level(F.array_max(F.transform(sized, lambda x: F.abs(x.cast("double"))))).alias("peak_dbfs"),
        level(F.sqrt(mean(lambda x: x * x))).alias("rms_dbfs"),
        mean(lambda x: F.when(F.abs(x) >= full_scale, 1.0).otherwise(0.0)).alias("clip_ratio"),
        mean(lambda x: x).alias("dc_offset"),
    ]
