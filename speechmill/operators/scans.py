"""Recurrences over ordered series, with state carried from range to range.

A recurrence gives each row a state that depends on the row and the state before: a clamped move, a gain, the level of a
buffer, a greedy choice. Rows are dealt into sorted ranges by (group, order), as many as their number asks for, so an
item that holds a third of all rows is many ranges. Only the first item of a range can have begun before it; so a
range needs one state from outside. Three passes:

1. each range sums its first item up to a map from the state before it to the state behind it, and runs its last item;
2. one task goes through the maps in order, a row for each range, and finds each range's first state;
3. each range runs its rows from there.

Maps compose because each recurrence is closed under composition: a gain is affine (two numbers), a buffer's level is
max(x + a, b) (two numbers), a clamped move is a monotone function of slopes 0 and 1 (its corners, which meet as soon
as all states reach one target), a greedy choice is a step function of the state before.

Ranges come from sampled bounds, so they are checkpointed before anything is derived from them. Equal keys (group and
order) stay in one range, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

from ..session import ready_for_checkpoints

RANGE_ROWS = 200_000

State = list[float] | None
Values = list[np.ndarray]


class Recurrence:
    """What a recurrence has to say. A state or a map is a list of numbers; None is the state before an item's first row."""

    #: Names and Arrow types of what a row gets.
    outputs: list[tuple[str, pa.DataType]]

    def run(self, values: Values, state: State) -> tuple[list, State]:
        """The rows' outputs and the state behind them."""
        raise NotImplementedError

    def summary(self, values: Values) -> list[float]:
        """The map of the rows, for any state before them but None."""
        raise NotImplementedError

    def apply(self, map_: list[float], state: list[float]) -> list[float]:
        raise NotImplementedError


class StepLimit(Recurrence):
    """Moves to each target by ``step`` at most; the first row is the anchor. Values: target, anchor."""

    def __init__(self, step: float, name: str = "value"):
        self.step, self.outputs = step, [(name, pa.float64())]

    def run(self, values, state):
        out, now = [], state[0] if state else None
        for target, anchor in zip(*(v.tolist() for v in values), strict=True):
            now = anchor if now is None else min(max(target, now - self.step), now + self.step)
            out.append(now)
        return [out], [now]

    def summary(self, values):
        """Corners (x, y) of the function from the state before to the state behind; slopes are 1 outside."""
        x = y = np.zeros(0)
        d = self.step
        for target in values[0].tolist():
            for edge in (target - d, target + d):  # where the function crosses an edge, it gets a corner
                if not len(y):
                    x, y = np.array([edge]), np.array([edge])
                    continue
                at = int(np.searchsorted(y, edge))
                if at < len(y) and y[at] == edge:
                    continue
                near = min(at, len(y) - 1)
                before = at - 1 if at > 0 else near
                base = before if at > 0 else near
                x, y = np.insert(x, at, x[base] + (edge - y[base])), np.insert(y, at, edge)
            # Between the edges it is the target itself, so that flat stretches stay flat whatever is rounded.
            y = np.where(y < target - d, np.minimum(y + d, target), np.where(y > target + d, np.maximum(y - d, target), target))
            if len(y) > 2:  # a corner between equal slopes is none
                rise = np.diff(y) > 0
                keep = np.concatenate([[True], rise[1:] != rise[:-1], [True]])
                x, y = x[keep], y[keep]
            if len(y) > 1 and y[0] != y[1]:
                x, y = x[1:], y[1:]
            if len(y) > 1 and y[-1] != y[-2]:
                x, y = x[:-1], y[:-1]
        return [*x.tolist(), *y.tolist()]

    def apply(self, map_, state):
        x, y = np.array(map_).reshape(2, -1)
        now = state[0]
        if not len(x):
            return state
        at = int(np.searchsorted(x, now))
        if at == len(x):
            return [float(y[-1] + (now - x[-1]))]
        if x[at] == now or at == 0:
            return [float(y[at] + (now - x[at]))]
        return [float(y[at - 1])] if y[at - 1] == y[at] else [float(y[at - 1] + (now - x[at - 1]))]


class Placed(Recurrence):
    """Another recurrence, with each row's place in its item, from 0."""

    def __init__(self, inner: Recurrence, name: str = "pos"):
        self.inner, self.outputs = inner, [(name, pa.int32()), *inner.outputs]

    def run(self, values, state):
        at, n = int(state[0]) if state else 0, len(values[0])
        out, behind = self.inner.run(values, state[1:] if state else None)
        return [list(range(at, at + n)), *out], [float(at + n), *behind]

    def summary(self, values):
        return [float(len(values[0])), *self.inner.summary(values)]

    def apply(self, map_, state):
        return [state[0] + map_[0], *self.inner.apply(map_[1:], state[1:])]


class Gain(Recurrence):
    """A slow automatic gain and a count of silent blocks. Values: rms.

    gain' = gain + (min(target / rms, most) - gain) * rate where there is sound at all; it is applied from 1 to ``most``.
    """

    outputs = [("gain", pa.float64()), ("silent", pa.bool_()), ("silent_ratio", pa.float64())]

    def __init__(self, target: float, most: float, rate: float, silence: float, floor: float = 1e-6):
        self.target, self.most, self.rate, self.silence, self.floor = target, most, rate, silence, floor

    def run(self, values, state):
        gain, silent, total = state or [1.0, 0.0, 0.0]
        gains, flags, ratios = [], [], []
        for rms in values[0].tolist():
            total += 1
            if rms > self.floor:
                gain += (min(self.target / rms, self.most) - gain) * self.rate
            quiet = rms < self.silence
            silent += quiet
            gains.append(min(max(gain, 1.0), self.most))
            flags.append(quiet)
            ratios.append(silent / total)
        return [gains, flags, ratios], [gain, silent, total]

    def summary(self, values):
        a, b = 1.0, 0.0
        for rms in values[0].tolist():
            if rms > self.floor:
                a, b = a * (1 - self.rate), b + (min(self.target / rms, self.most) - b) * self.rate
        return [a, b, float((values[0] < self.silence).sum()), float(len(values[0]))]

    def apply(self, map_, state):
        a, b, silent, total = map_
        return [a * state[0] + b, state[1] + silent, state[2] + total]


class Buffer(Recurrence):
    """A buffer that takes and gives samples; what is missing is filled with zeros. Values: put, get."""

    outputs = [("level", pa.float64()), ("filled", pa.float64()), ("underrun", pa.bool_())]

    def run(self, values, state):
        level = state[0] if state else 0.0
        levels, filled = [], []
        for put, get in zip(*(v.tolist() for v in values), strict=True):
            level += put
            filled.append(max(0.0, get - level))
            level = max(0.0, level - get)
            levels.append(level)
        return [levels, filled, [x > 0 for x in filled]], [level]

    def summary(self, values):
        a, b = 0.0, 0.0  # x -> max(x + a, b)
        for change in (values[0] - values[1]).tolist():
            a, b = a + change, max(b + change, 0.0)
        return [a, b]

    def apply(self, map_, state):
        return [max(state[0] + map_[0], map_[1])]


class Total(Recurrence):
    """The sum of an item's values before each row. Values: value."""

    def __init__(self, name: str = "before"):
        self.outputs = [(name, pa.float64())]

    def run(self, values, state):
        sums = np.cumsum(np.concatenate([[state[0] if state else 0.0], values[0]]))
        return [sums[:-1]], [float(sums[-1])]

    def summary(self, values):
        return [float(values[0].sum())]

    def apply(self, map_, state):
        return [state[0] + map_[0]]


class PickApart(Recurrence):
    """Takes each interval that begins at the end of the one taken before, or up to ``room`` earlier. Values: start, end; in order of start.

    ``number`` counts an item's taken intervals; it is null for the others.
    """

    outputs = [("number", pa.int64())]

    def __init__(self, room: float):
        self.room = room

    def run(self, values, state):
        end, count = state or [-np.inf, 0.0]
        out = []
        for start, stop in zip(*(v.tolist() for v in values), strict=True):
            taken = start >= end - self.room
            if taken:
                end, count = stop, count + 1
            out.append(int(count) if taken else None)
        return [out], [end, count]

    def summary(self, values):
        """For an end up to each limit: the last end and the number taken. Limits rise with starts."""
        start, end = values
        n = len(start)
        after = np.searchsorted(start, end - self.room)  # the next that fits behind i, if it comes later than i
        after = np.maximum(after, np.arange(n) + 1)
        last, count = end.astype(float).copy(), np.ones(n)
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                last[i], count[i] = last[after[i]], count[after[i]] + 1
        new = np.ones(n, bool)
        new[:-1] = (last[1:] != last[:-1]) | (count[1:] != count[:-1])  # of equal results the highest limit says all
        return [*start[new].tolist(), *last[new].tolist(), *count[new].tolist()]

    def apply(self, map_, state):
        limit, last, count = np.array(map_).reshape(3, -1)
        at = int(np.searchsorted(limit, state[0] - self.room))
        return [float(last[at]), state[1] + float(count[at])] if at < len(limit) else state


class EarlyStop(Recurrence):
    """The best value so far, by more than ``least``, its place, and whether ``patience`` rows in a row did not better it. Values: value.

    Places count from 0; ``stopped_at`` is the first place where patience ends, null before.
    """

    outputs = [("best", pa.float64()), ("best_at", pa.int64()), ("stopped_at", pa.int64())]

    def __init__(self, patience: int, least: float):
        self.patience, self.least = patience, least

    def run(self, values, state):
        best, best_at, bad, at, stop = state or [np.nan, -1.0, 0.0, 0.0, -1.0]
        out = [], [], []
        for v in values[0].tolist():
            if stop < 0:
                if not v >= best - self.least:  # also while there is no best yet
                    best, best_at, bad = v, at, 0.0
                else:
                    bad += 1
                    if bad >= self.patience:
                        stop = at
            at += 1
            for column, x in zip(out, (best, int(best_at), int(stop) if stop >= 0 else None), strict=True):
                column.append(x)
        return list(out), [best, best_at, bad, at, stop]

    def summary(self, values):
        """For each value that is lower than all before it, what a run that betters its best there comes to."""
        v = values[0]
        lows = np.flatnonzero(np.concatenate([[True], v[1:] < np.minimum.accumulate(v)[:-1]]))
        out = [float(len(v))]
        for i in lows.tolist():
            _, (best, best_at, bad, _, stop) = self.run([v[i:]], None)
            out += [v[i], float(i), best, best_at + i, bad, stop + i if stop >= 0 else -1.0]
        return out

    def apply(self, map_, state):
        best, best_at, bad, at, stop = state
        n = map_[0]
        if stop >= 0:
            return [best, best_at, bad, at + n, stop]
        rows = np.array(map_[1:]).reshape(-1, 6)
        better = np.flatnonzero(~(rows[:, 0] >= best - self.least))
        first = rows[better[0]] if len(better) else None
        worse = n if first is None else first[1]  # rows before the first that is better
        if bad + worse >= self.patience:
            return [best, best_at, float(self.patience), at + n, at + self.patience - bad - 1]
        if first is None:
            return [best, best_at, bad + n, at + n, -1.0]
        return [float(first[2]), at + float(first[3]), float(first[4]), at + n, at + float(first[5]) if first[5] >= 0 else -1.0]


def _runs(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[object, pa.Table]]:
    """Neighbouring rows of one item; they are sorted, so an item is one run in its range."""
    held: list[pa.RecordBatch] = []
    key: object = None
    for batch in batches:
        values = batch.column(group)
        if batch.num_rows == 0:
            continue
        codes = values.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            mine = values[lo].as_py()
            if held and mine != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = mine
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def carried(rows: DataFrame, group: str, order: list[str], values: list[Column], recurrence: Recurrence, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with what the recurrence gives to each: items in order, from the values of each row (numbers, not null).

    Defined cases: rows whose group is null are an item of their own; repeated keys come in any order among
    themselves; an empty table gives no rows.
    """
    ready_for_checkpoints(rows.sparkSession)
    names = [f"_v{i}" for i in range(len(values))]
    parts = max(1, -(-rows.count() // range_rows))
    dealt = rows.withColumns({n: v.cast("double") for n, v in zip(names, values, strict=True)}).repartitionByRange(parts, group, *order)
    dealt = dealt.sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    key = dealt.schema[group].dataType
    numbers = T.ArrayType(T.DoubleType())
    heads = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", key), T.StructField("map", numbers), T.StructField("fresh", numbers), T.StructField("last", key), T.StructField("behind", numbers)])
    arrow_heads = to_arrow_schema(heads)
    given = lambda t: [t.column(n).to_numpy() for n in names]

    def summed_up(batches):
        part = first = last = None
        for name, run in _runs(batches, group):
            if first is None:
                part = run.column("_part")[0].as_py()
                first = (name, recurrence.summary(given(run)), recurrence.run(given(run), None)[1])
            else:
                last = (name, run)
        if first is not None:
            behind = recurrence.run(given(last[1]), None)[1] if last else None
            one = {"part": part, "first": first[0], "map": first[1], "fresh": first[2], "last": last[0] if last else first[0], "behind": behind}
            yield pa.RecordBatch.from_pylist([one], arrow_heads)

    starts = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("state", numbers)])
    arrow_starts = to_arrow_schema(starts)

    def chained(batches):
        last, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                goes_on = state is not None and last == row["first"]
                if goes_on:
                    yield pa.RecordBatch.from_pylist([{"part": row["part"], "state": state}], arrow_starts)
                ahead = recurrence.apply(row["map"], state) if goes_on else row["fresh"]
                last, state = row["last"], row["behind"] if row["behind"] is not None else ahead

    # One row for each range, of numbers; the result is at most one state for each range.
    chain = dealt.mapInArrow(summed_up, heads).repartition(1).sortWithinPartitions("part").mapInArrow(chained, starts)
    begin = rows.sparkSession.sparkContext.broadcast({r.part: list(r.state) for r in chain.collect()})
    added = [T.StructField(n, from_arrow_type(k)) for n, k in recurrence.outputs]
    schema = T.StructType([*rows.schema.fields, *added])

    def filled_in(batches):
        whole = to_arrow_schema(schema)
        first = True
        for _, run in _runs(batches, group):
            state = begin.value.get(run.column("_part")[0].as_py()) if first else None
            first = False
            out, _ = recurrence.run(given(run), state)
            kept = run.drop_columns([*names, "_part"])
            for (name, kind), column in zip(recurrence.outputs, out, strict=True):
                kept = kept.append_column(name, pa.array(column, kind))
            yield from kept.cast(whole).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(filled_in, schema)


def step_limited(rows: DataFrame, group: str, order: list[str], target: str, step: float, anchor: float | None = None, name: str = "smooth", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds pos and values that move by ``step`` at most; an item's first is the anchor, or else its targets' mean."""
    limited = Placed(StepLimit(step, name))
    if anchor is None:
        mean = rows.groupBy(group).agg(F.avg(target).alias("_anchor")).withColumnRenamed(group, "_of")
        rows = rows.join(mean, F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of")
        return carried(rows, group, order, [F.col(target), F.col("_anchor")], limited, range_rows).drop("_anchor")
    return carried(rows, group, order, [F.col(target), F.lit(anchor)], limited, range_rows)


def gain_control(blocks: DataFrame, group: str, order: list[str], rms: str, target: float = 0.1, most: float = 8.0, rate: float = 0.05, silence: float = 0.003, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds pos, gain, silent and silent_ratio (the share so far) to a session's blocks."""
    return carried(blocks, group, order, [F.col(rms)], Placed(Gain(target, most, rate, silence)), range_rows)


def buffered(moves: DataFrame, group: str, order: list[str], put: str, get: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds pos, level, filled and underrun to a buffer's moves: first ``put`` samples come, then ``get`` are taken."""
    return carried(moves, group, order, [F.col(put), F.col(get)], Placed(Buffer()), range_rows)


def picked_apart(intervals: DataFrame, group: str, start: str, end: str, room: float, most: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The intervals that a left-to-right choice takes, ``most`` of each item at most, with their ``number``."""
    taken = carried(intervals, group, [start, end], [F.col(start), F.col(end)], PickApart(room), range_rows).filter("number is not null")
    return taken if most is None else taken.filter(F.col("number") <= most)


def early_stops(series: DataFrame, group: str, order: list[str], value: str, patience: int, least: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """group, best, best_at and stopped_at of each series."""
    rows = carried(series, group, order, [F.col(value)], EarlyStop(patience, least), range_rows)
    return rows.groupBy(group).agg(F.max_by(F.struct("best", "best_at", "stopped_at"), F.struct(*order)).alias("s")).select(group, "s.*")


def character_spans(speech: DataFrame, texts: DataFrame, item: str, range_rows: int = RANGE_ROWS, least: float = 0.15) -> DataFrame:
    """``item``, pos, start, end: when each character of an item's text is spoken.

    speech: item, start, end of its stretches of speech, of which those under ``least`` seconds don't count. texts: item,
    chars, seconds (used where there is no stretch). Characters take equal shares of all the speech, in order; one that
    would reach over the end of its stretch ends there. Instead of a range join, each stretch makes the characters that
    begin in it, from the sum of the stretches before; so an item's characters are as many tasks' work as its stretches.
    """
    known = speech.filter(F.col("end") - F.col("start") >= least).select(item, "start", "end")
    bare = texts.join(known.select(item).distinct(), item, "left_anti").select(item, F.lit(0.0).alias("start"), F.col("seconds").cast("double").alias("end"))
    known = known.join(texts.select(item), item, "left_semi").unionByName(bare).withColumn("_length", F.col("end") - F.col("start"))
    placed = carried(known, item, ["start", "end"], [F.col("_length")], Total("_before"), range_rows)
    whole = known.groupBy(item).agg(F.sum("_length").alias("_whole"))
    shares = texts.join(whole, item).filter("chars > 0 and _whole > 0").select(item, "chars", (F.col("_whole") / F.col("chars")).alias("_share"))
    rows = placed.join(shares, item)
    # Character k begins at k shares; sums are rounded to whole shares where they are within a millionth of one.
    first = lambda at: F.ceil(at / F.col("_share") - 1e-6)
    rows = rows.withColumns({"_lo": F.greatest(first(F.col("_before")), F.lit(0)), "_hi": F.least(first(F.col("_before") + F.col("_length")), F.col("chars")) - 1}).filter("_lo <= _hi")
    rows = rows.withColumn("pos", F.explode(F.sequence("_lo", "_hi")))
    start = F.col("start") + F.greatest(F.col("pos") * F.col("_share") - F.col("_before"), F.lit(0.0))
    return rows.select(item, "pos", start.alias("start"), F.least(start + F.col("_share"), F.col("end")).alias("end"))
