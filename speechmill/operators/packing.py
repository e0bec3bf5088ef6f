"""Steps over one item's short series that depend on all before them: length buckets and octave repair.

Spark deals the items to tasks; a group is one item's segments or frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GROWTH = 1.5


def _buckets(lengths: list[int], most: int) -> list[list[int]]:
    """Places of the lengths (in rising order) by bucket."""
    open_: list[list[int]] = []
    middle = 0
    for at, n in enumerate(lengths):
        if n == 0:
            continue
        if not open_ or len(open_[-1]) >= most or n >= int(middle * GROWTH):
            open_.append([])
        open_[-1].append(at)
        middle = lengths[open_[-1][len(open_[-1]) // 2]]
    whole, single = [b for b in open_ if len(b) > 1], [b[0] for b in open_ if len(b) == 1]
    for b in whole:
        if single and len(b) < most:
            b.append(single.pop(0))
    return whole + [single[k : k + most] for k in range(0, len(single), most)]


def length_buckets(rows: DataFrame, group: str, order: str, length: str, most: int = 4) -> DataFrame:
    """group, order, bucket: segments of like length together, up to ``most``.

    A bucket ends when it is full or when a length is one and a half times that of its middle segment; single segments
    fill the first buckets with room, one each, then stand together. Empty segments have no bucket, unless all the
    item's segments fit into one.
    """

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length, order], kind="stable")
        sizes = frame[length].fillna(0).astype(int).tolist()
        places = [list(range(len(sizes)))] if len(sizes) <= most else _buckets(sizes, most)
        at = [(k, b) for b, inside in enumerate(places) for k in inside]
        out = frame.iloc[[k for k, _ in at]][[group, order]].copy()
        out["bucket"] = [b for _, b in at]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(group, order, length).groupBy(group).applyInPandas(deal, f"{group} {kinds[group]}, {order} {kinds[order]}, bucket int")


def _most_common(values: np.ndarray) -> float:
    kinds, counts = np.unique(np.round(values * 10) / 10, return_counts=True)
    return float(kinds[np.argmax(counts)])


def _without_octave_jumps(hz: np.ndarray, tolerance: float, reach: int) -> np.ndarray:
    voiced = hz > 0
    logs = np.log2(hz[voiced])
    steps = np.diff(logs)
    if len(logs) < 5:
        return hz
    flat, done = steps.copy(), -1
    for i in np.flatnonzero(np.abs(np.abs(steps) - 1) <= tolerance):
        back = np.flatnonzero(np.abs(steps[i + 1 : i + 1 + reach] + steps[i]) <= 2 * tolerance)
        if i > done and back.size:
            done = i + 1 + back[0]
            flat[[i, done]] = 0.0
    if done < 0:
        return hz
    fixed = logs[0] + np.concatenate([[0.0], np.cumsum(flat)]) + _most_common(steps) - _most_common(flat)
    out = np.zeros_like(hz)
    out[voiced] = np.exp2(fixed)
    return out


def octave_repair(frames: DataFrame, tolerance: float = 0.08, reach: int = 80) -> DataFrame:
    """item, pos, hz: a jump of an octave that turns back within ``reach`` voiced frames is undone with its return.

    The curve is then moved by what that changed of its commonest step. Items of fewer than five voiced frames, and
    jumps that stay, are left as they are; a null pitch is unvoiced.
    """

    def repair(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", kind="stable")
        return frame.assign(hz=_without_octave_jumps(frame["hz"].fillna(0.0).to_numpy(dtype=float), tolerance, reach))

    rows = frames.select("item", "pos", frames["hz"].cast("double").alias("hz"))
    return rows.groupBy("item").applyInPandas(repair, rows.schema)
