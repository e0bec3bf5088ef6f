"""Sliding windows over level frames: five weighted terms, and the best windows that don't overlap.

Frames (item, pos, db, energy, clipped, samples) are first added up in cells of one step; a window is a fixed number of
cells, so a cell goes to each of its windows and sums are combined before the shuffle. No task gathers an item's frames:
a cell's sums are a fiftieth of its frames, and each goes to two dozen windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import suppress_overlaps

# What counts as voice below the loudest frame, where terms end, and what they weigh.
VOICED_DB, FULL_VOICE, FULL_SNR, LOUDNESS, LOUDNESS_REACH = 35.0, 0.80, 30.0, -20.0, 14.0
VOICE_WEIGHT, SNR_WEIGHT, LOUDNESS_WEIGHT, EDGE_WEIGHT = 40.0, 30.0, 12.0, 3.0
CLEAN, CLIPPED, CLEAN_POINTS, CLIPPED_POINTS, SOME_POINTS, EDGE_DB = 0.0005, 0.002, 12.0, -25.0, -8.0, 20.0


def _db(energy: Column, samples: Column) -> Column:
    return 20 * F.log10(F.greatest(F.sqrt(energy / samples), F.lit(1e-10)))


def scored_windows(frames: DataFrame, window: int, step: int, least: int, edge: int = 2) -> DataFrame:
    """item, first, frames, score, snr, voiced_ratio, clip_ratio, rms_db of each window of ``window`` frames, each ``step`` frames.

    energy is a frame's sum of squares, clipped its samples at full scale. Levels are taken up to the frame behind the
    window. An item shorter than a window has one window of all its frames, if they are ``least`` at least. ``window``
    is a multiple of ``step``, which has 2 * ``edge`` frames or more.
    """
    if window % step or step < 2 * edge:
        raise ValueError("a window is a number of steps, a step at least both edges")
    wide = window // step
    whole = frames.groupBy("item").agg(F.max("db").alias("peak"), (F.max("pos") + 1).alias("n"))
    rows = frames.join(whole, "item").withColumn("cell", F.floor(F.col("pos") / step))
    short, place = F.col("n") < window, F.pmod("pos", F.lit(step))
    voiced, head = F.col("db") >= F.col("peak") - VOICED_DB, place < edge
    tail = F.when(short, F.col("pos") >= F.col("n") - edge).otherwise(place >= step - edge)
    # The frame behind a window counts for its levels only: the first of a cell also goes to the window that ends there.
    levels = {"voices": voiced.cast("int"), "all": F.lit(1), "voice_db": F.when(voiced, F.col("db")).otherwise(0.0), "all_db": F.col("db")}
    sums = {**levels, "energy": F.col("energy"), "clips": F.col("clipped"), "samples": F.col("samples")}
    edges = {f"{n}_{k}": F.when(flag, F.col(v)) for n, flag in (("head", head), ("tail", tail)) for k, v in (("energy", "energy"), ("samples", "samples"))}
    cells = rows.groupBy("item", "cell", "peak", "n").agg(
        *[F.sum(c).alias(k) for k, c in {**sums, **edges}.items()], *[F.sum(F.when(place == 0, c)).alias(f"next_{k}") for k, c in levels.items()],
    )
    last = F.greatest(F.lit(0), F.floor((F.col("n") - window) / step))
    inside = F.sequence(F.greatest(F.col("cell") - (wide - 1), F.lit(0)), F.greatest(F.least(F.col("cell"), last), F.greatest(F.col("cell") - (wide - 1), F.lit(0))))
    spread = cells.withColumn("w", F.explode(F.concat(inside, F.when(F.col("cell") >= wide, F.array(F.col("cell") - wide)).otherwise(F.array().cast("array<bigint>")))))
    spread = spread.filter((F.col("w") <= last) & (F.col("w") >= F.col("cell") - wide))
    behind, at_start, at_end = F.col("cell") == F.col("w") + wide, F.col("cell") == F.col("w"), (F.col("cell") == F.col("w") + wide - 1) | short
    total = {k: F.sum(F.when(behind, F.col(f"next_{k}")).otherwise(F.col(k)) if k in levels else F.when(~behind, F.col(k))) for k in sums}
    total |= {k: F.sum(F.when(at_start if k.startswith("head") else at_end & ~behind, F.col(k))) for k in edges}
    w = spread.groupBy("item", "w", "peak", "n").agg(*[c.alias(k) for k, c in total.items()])
    w = w.withColumns({"first": F.col("w") * step, "frames": F.least(F.lit(window), F.col("n") - F.col("w") * step)}).filter(F.col("frames") >= least)
    ratio = F.col("voices") / F.col("all")
    quiet = F.col("all") - F.col("voices")
    snr = F.when((F.col("voices") > 0) & (quiet > 0), F.col("voice_db") / F.col("voices") - (F.col("all_db") - F.col("voice_db")) / quiet).when(quiet == 0, 60.0).otherwise(0.0)
    clip, rms = F.col("clips") / F.col("samples"), _db(F.col("energy"), F.col("samples"))
    w = w.withColumns({"voiced_ratio": ratio, "snr": snr, "clip_ratio": clip, "rms_db": rms})
    one, none = F.lit(1.0), F.lit(0.0)
    score = VOICE_WEIGHT * F.least(one, F.col("voiced_ratio") / FULL_VOICE) + SNR_WEIGHT * F.least(one, F.greatest(none, F.col("snr")) / FULL_SNR)
    score = score + F.when(F.col("clip_ratio") < CLEAN, CLEAN_POINTS).when(F.col("clip_ratio") > CLIPPED, CLIPPED_POINTS).otherwise(SOME_POINTS)
    score = score + LOUDNESS_WEIGHT * F.greatest(none, 1 - F.abs(F.col("rms_db") - LOUDNESS) / LOUDNESS_REACH)
    for side in ("head", "tail"):
        level = _db(F.col(f"{side}_energy"), F.col(f"{side}_samples"))
        score = score + EDGE_WEIGHT * (1 - F.least(one, F.greatest(none, (level - (F.col("peak") - VOICED_DB)) / EDGE_DB)))
    return w.select("item", "first", "frames", score.alias("score"), "snr", "voiced_ratio", "clip_ratio", "rms_db")


def best_windows(windows: DataFrame, window: int, step: int, share: float = 0.6, most: int = 8) -> DataFrame:
    """Of each item's windows the ``most`` best of which none overlaps a better one by more than ``share`` of itself.

    Windows are of one length, so a kept one stands in the way of those less than (1 - share) of it away; the ``most``
    kept ones are therefore among so many times ``most`` of the best, and no task takes more of an item.
    """
    near = 2 * int(-(-(1 - share) * window // step)) + 1
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "first"))
    top = windows.withColumn("_rank", rank).filter(F.col("_rank") <= most * near).drop("_rank").withColumn("_end", F.col("first") + F.col("frames"))
    return suppress_overlaps(top, "item", "first", "_end", "score", share, most).drop("_end")
