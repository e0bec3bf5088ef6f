"""Sessions of samples as streams with state: chunks with context, and overlap-added pieces.

A session's rows (session, seq, samples, last) may come in any order, several times, and over many micro-batches: what is
ahead of its turn waits in map state under its number, what has had its turn is ignored. The row marked ``last``
ends a session when its turn comes: what is still held is given out and all its state is removed. A session that
sends nothing for ``idle_ms`` is ended by a timer, which gives out what waits, in order, without what never came. So state
holds open sessions only, and an id that comes again after its end is a new session from number 0.

Machines that turn samples into rows know nothing of Spark; what they hold between calls is one row of value state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .windows import Chunker

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Chunks:
    """Blocks with left and right context at absolute offsets (``Chunker``), whatever pieces the samples come in."""

    columns = "start long, samples array<double>, lead long"
    state = "offset long, samples array<double>"

    def __init__(self, block: int, left: int, right: int):
        self.sizes = block, left, right

    def feed(self, state: tuple | None, samples: list[float], last: bool) -> tuple[list[tuple], tuple]:
        chunker = Chunker(*self.sizes, (state[0], list(state[1])) if state else (0, []))
        out = list(chunker.feed(list(samples)))
        return (out + list(chunker.finish()) if last else out), chunker.state()

    def finish(self, state: tuple | None) -> list[tuple]:
        return self.feed(state, [], True)[0]


class OverlapAdd:
    """Pieces whose first ``overlap`` samples stand for the same time as the last ones of the piece before.

    These are crossfaded with a raised cosine; the end of a session fades out over ``fade`` samples, if it is longer.
    """

    columns = "start long, samples array<double>, done boolean"
    state = "offset long, tail array<double>, begun boolean"

    def __init__(self, overlap: int, fade: int = 512):
        self.overlap, self.fade = overlap, fade

    def _ended(self, samples: np.ndarray) -> np.ndarray:
        if len(samples) > self.fade:
            samples = samples.copy()
            samples[len(samples) - self.fade :] *= np.linspace(1.0, 0.0, self.fade)
        return samples

    def feed(self, state: tuple | None, samples: list[float], last: bool) -> tuple[list[tuple], tuple]:
        offset, tail, begun = (state[0], np.array(state[1], float), state[2]) if state else (0, np.zeros(0), False)
        piece = np.array(samples, float)
        n = min(len(tail), len(piece[: self.overlap])) if begun else 0
        window = np.hanning(2 * n)
        mixed = tail[:n] * window[n:] + piece[:n] * window[:n]
        rest = piece[n:] if len(piece) > n else tail[n:]  # a piece shorter than what it overlaps leaves the rest of that
        keep = len(rest) if last else max(0, len(rest) - self.overlap)
        out = np.concatenate([mixed, rest[:keep]])
        out = self._ended(out) if last else out
        rows = [(offset, out.tolist(), last)] if len(out) or last else []
        return rows, (offset + len(out), rest[keep:].tolist(), True)

    def finish(self, state: tuple | None) -> list[tuple]:
        if not state:
            return []
        return [(state[0], self._ended(np.array(state[1], float)).tolist(), True)]


class _Sessions(StatefulProcessor):
    def __init__(self, machine, idle_ms: int | None):
        self.machine, self.idle_ms = machine, idle_ms
        self.names = ["session", *(c.split()[0] for c in machine.columns.split(", "))]

    def init(self, handle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "next long, last long")
        self.waiting = handle.getMapState("waiting", "seq long", "samples array<double>")
        self.held = handle.getValueState("held", self.machine.state)

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=self.names)

    def _clear(self) -> None:
        for state in (self.turn, self.waiting, self.held):
            state.clear()
        for at in list(self.handle.listTimers()) if self.idle_ms else []:
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, last = self.turn.get() if self.turn.exists() else (0, -1)
        state = self.held.get() if self.held.exists() else None
        new: dict[int, list[float]] = {}
        for frame in rows:
            for seq, samples, ends in zip(frame["seq"], frame["samples"], frame["last"], strict=True):
                if seq >= at:
                    new[int(seq)] = [float(x) for x in samples]
                    last = int(seq) if ends else last
        out: list[tuple] = []
        ended = False
        while not ended:
            if at in new:
                samples = new.pop(at)
            elif self.waiting.containsKey((at,)):
                samples = list(self.waiting.getValue((at,))[0])
            else:
                break
            self.waiting.removeKey((at,))
            ended = at == last
            more, state = self.machine.feed(state, samples, ended)
            out += more
            at += 1
        if ended:
            self._clear()
        else:
            for seq, samples in new.items():
                self.waiting.updateValue((seq,), (samples,))
            self.turn.update((at, last))
            if state is not None:
                self.held.update(state)
            if self.idle_ms:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        out: list[tuple] = []
        for (_,), (samples,) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            more, state = self.machine.feed(state, list(samples), False)
            out += more
        out += self.machine.finish(state)
        self._clear()
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def by_session(samples: DataFrame, machine, idle_ms: int | None = None) -> DataFrame:
    """session and the machine's columns, of a stream (append mode) or a table of (session, seq, samples, last).

    Rows of one session are one task's work, as its state is; sessions are dealt over all tasks.
    """
    spark: SparkSession = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # map state and timers need it
    spark.streams.active  # noqa: B018  starts what keeps track of state, which a table's run needs as well
    rows = samples.select("session", "seq", "samples", "last")
    mode = "ProcessingTime" if idle_ms else "None"
    return rows.groupBy("session").transformWithStateInPandas(_Sessions(machine, idle_ms), f"session string, {machine.columns}", "Append", mode)


def chunked(samples: DataFrame, block: int, left: int, right: int, idle_ms: int | None = None) -> DataFrame:
    """Blocks (session, start, samples, lead) with context."""
    return by_session(samples, Chunks(block, left, right), idle_ms)


def overlap_added(pieces: DataFrame, overlap: int, fade: int = 512, idle_ms: int | None = None) -> DataFrame:
    """session, start, samples, done: the joined pieces, each as soon as its turn comes."""
    return by_session(pieces, OverlapAdd(overlap, fade), idle_ms)
