"""Streams: event-time windows with watermarks, running status, and the cutting of samples into blocks.

Event-time windows have no counterpart among the corpus tools, whose time is the sample index; the chunker has, and
``sessions`` runs it as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and kind; on a stream, rows later than ``late`` are dropped."""
    at = events.withColumn("_at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("_at", late)
    sums = at.groupBy(F.window("_at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    at = events.withColumn("_at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("_at", late)
    done = at.groupBy(F.session_window("_at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return done.select("user_id", F.unix_seconds("session_window.start").alias("start"), F.unix_seconds("session_window.end").alias("end"), "n")


def running_status(blocks: DataFrame) -> DataFrame:
    """Blocks, underruns and share of silence of each session so far; for update or complete mode."""
    return blocks.groupBy("session").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("underrun").cast("int")).alias("underruns"), F.avg(F.col("silent").cast("double")).alias("silent_ratio"))


class Chunker:
    """Cuts a session's samples into blocks with left and right context, at absolute offsets.

    A block is given out as soon as its right context is there; every call gives out all that are ready, and
    ``finish`` the rest. However the samples arrive, the blocks are the same.
    """

    def __init__(self, block: int, left: int, right: int, state: tuple[int, list[float]] = (0, [])):
        self.block, self.left, self.right = block, left, right
        self.offset, self.samples = state[0], list(state[1])  # samples from max(0, offset - left) on

    def _held_from(self) -> int:
        return max(0, self.offset - self.left)

    def _cut(self, size: int) -> tuple[int, list[float], int]:
        lead = self.offset - self._held_from()
        out = (self.offset, self.samples[: lead + size + self.right], lead)
        before = self._held_from()
        self.offset += size
        self.samples = self.samples[self._held_from() - before :]
        return out

    def feed(self, samples: list[float]) -> Iterator[tuple[int, list[float], int]]:
        self.samples.extend(samples)
        while len(self.samples) - (self.offset - self._held_from()) >= self.block + self.right:
            yield self._cut(self.block)

    def finish(self) -> Iterator[tuple[int, list[float], int]]:
        while (rest := len(self.samples) - (self.offset - self._held_from())) > 0:
            yield self._cut(min(self.block, rest))

    def state(self) -> tuple[int, list[float]]:
        return self.offset, self.samples
