"""Recurrences carried from range to range, against plain loops; one item holds a third of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmill.operators import scans

ROWS = "item string, at long, value double, other double"


def series(seed, n=900, tied=False):
    draw = random.Random(seed)
    items = ["hot"] * (n // 3) + [f"i{draw.randint(0, 40)}" for _ in range(n - n // 3 - 5)] + [None] * 5
    return [(item, k, draw.choice([1.0, 2.0, 3.0, 4.5]) if tied else draw.uniform(-30, 30), draw.uniform(0, 9)) for k, item in enumerate(items)]


def by_item(rows, order):
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(r[0], []).append(r)
    return out


def got(df, *columns):
    out = {}
    for r in df.orderBy("item", "at").collect():
        out.setdefault(r["item"], []).append(tuple(r[c] for c in columns))
    return out


@pytest.mark.parametrize(("step", "anchor", "range_rows"), [(2.5, 50.0, 10_000), (0.3, -100.0, 20), (2.5, None, 20)])
def test_step_limit(spark, step, anchor, range_rows):
    rows = series(1)
    want = {}
    for item, mine in by_item(rows, lambda r: r[1]).items():
        now, out = None, []
        for k, (_, _, target, _) in enumerate(mine):
            first = anchor if anchor is not None else sum(r[2] for r in mine) / len(mine)
            now = first if now is None else min(max(target, now - step), now + step)
            out.append((k, pytest.approx(now, abs=1e-9)))
        want[item] = out
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert got(scans.step_limited(df, "item", ["at"], "value", step, anchor, range_rows=range_rows), "pos", "smooth") == want


@pytest.mark.parametrize("range_rows", [20])
def test_gain(spark, range_rows):
    rows = [(i, k, abs(v) / 100 if k % 7 else 0.0, o) for i, k, v, o in series(2)]
    want = {}
    for item, mine in by_item(rows, lambda r: r[1]).items():
        gain, silent, out = 1.0, 0, []
        for k, (_, _, rms, _) in enumerate(mine):
            if rms > 1e-6:
                gain += (min(0.1 / rms, 8.0) - gain) * 0.05
            silent += rms < 0.05
            out.append((k, pytest.approx(min(max(gain, 1.0), 8.0), abs=1e-9), rms < 0.05, pytest.approx(silent / (k + 1))))
        want[item] = out
    df = spark.createDataFrame(rows, ROWS)
    assert got(scans.gain_control(df, "item", ["at"], "value", silence=0.05, range_rows=range_rows), "pos", "gain", "silent", "silent_ratio") == want


@pytest.mark.parametrize("range_rows", [20])
def test_buffer(spark, range_rows):
    rows = [(i, k, float(int(abs(v))), float(int(3 * o))) for i, k, v, o in series(3)]
    want = {}
    for item, mine in by_item(rows, lambda r: r[1]).items():
        level, out = 0.0, []
        for _, _, put, get in mine:
            have = level + put
            level = max(0.0, have - get)
            out.append((level, max(0.0, get - have), get > have))
        want[item] = out
    assert got(scans.buffered(spark.createDataFrame(rows, ROWS), "item", ["at"], "value", "other", range_rows), "level", "filled", "underrun") == want


@pytest.mark.parametrize(("range_rows", "room"), [(20, 0.05), (60, 3.0)])
def test_picks(spark, range_rows, room):
    rows = [(i, k, round(abs(v), 1), round(abs(v), 1) + o) for i, k, v, o in series(4)]
    want = []
    for item, mine in by_item(rows, lambda r: (r[2], r[3])).items():
        end, count = -np.inf, 0
        for _, _, start, stop in mine:
            if start >= end - room:
                end, count = stop, count + 1
                want.append((item, start, stop, count))
    df = scans.picked_apart(spark.createDataFrame(rows, ROWS), "item", "value", "other", room, range_rows=range_rows)
    key = lambda r: (r[0] or "", r[3])
    assert sorted((tuple(r) for r in df.select("item", "value", "other", "number").collect()), key=key) == sorted(want, key=key)
    assert scans.picked_apart(spark.createDataFrame(rows, ROWS), "item", "value", "other", room, 2, range_rows).count() == sum(w[3] <= 2 for w in want)


@pytest.mark.parametrize(("patience", "least", "tied", "range_rows"), [(3, 1e-4, False, 60), (60, 1.6, True, 20), (500, 0.5, False, 20)])
def test_early_stops(spark, patience, least, tied, range_rows):
    rows = series(5, tied=tied)
    want = {}
    for item, mine in by_item(rows, lambda r: r[1]).items():
        best = best_at = stop = None
        bad = 0
        for k, (_, _, v, _) in enumerate(mine):
            if best is None or v < best - least:
                best, best_at, bad = v, k, 0
            else:
                bad += 1
                if bad >= patience:
                    stop = k
                    break
        want[item] = (best, best_at, stop)
    df = scans.early_stops(spark.createDataFrame(rows, ROWS), "item", ["at"], "value", patience, least, range_rows)
    assert {r.item: (r.best, r.best_at, r.stopped_at) for r in df.collect()} == want


def test_character_spans(spark):
    """Shares of all speech in order, by a walk over the stretches; an item without speech has its whole length."""
    draw = random.Random(8)
    speech = [("hot", float(10 * k), 10 * k + draw.uniform(0.1, 8)) for k in range(60)] + [("b", 1.0, 2.0), ("b", 3.0, 3.1), ("gone", 0.0, 1.0)]
    chars = {"hot": 500, "b": 4, "none": 3, "empty": 0}
    want = {}
    for item, n in chars.items():
        parts = [(a, b) for i, a, b in speech if i == item and b - a >= 0.15] or [(0.0, 6.0)]
        share, before, at = sum(b - a for a, b in parts) / max(n, 1), 0.0, 0
        for a, b in parts:
            while at < n and at * share < before + b - a - 1e-9:
                start = a + max(0.0, at * share - before)
                want[item, at] = (pytest.approx(start), pytest.approx(min(start + share, b)))
                at += 1
            before += b - a
    texts = spark.createDataFrame([(i, n, 6.0) for i, n in chars.items()], "item string, chars long, seconds double")
    got = scans.character_spans(spark.createDataFrame(speech, "item string, start double, end double"), texts, "item", range_rows=9)
    assert {(r["item"], r.pos): (r.start, r.end) for r in got.collect()} == want


def test_maps_are_those_of_the_rows():
    """A map says for every state what running the rows says."""
    draw = random.Random(9)
    for _ in range(300):
        n = draw.randint(1, 25)
        values = [np.array([draw.choice([draw.uniform(-5, 5), 1.0, 2.0]) for _ in range(n)]), np.array([draw.uniform(0, 4) for _ in range(n)])]
        state = [draw.uniform(-12, 12)]
        one = scans.StepLimit(draw.choice([0.1, 1.0, 4.0]))
        assert one.apply(one.summary(values), state) == pytest.approx(one.run(values, state)[1], abs=1e-9)
        one = scans.Buffer()
        assert one.apply(one.summary(values), [abs(state[0])]) == pytest.approx(one.run(values, [abs(state[0])])[1])
        start = np.sort(values[0])
        one = scans.PickApart(draw.choice([0.0, 0.5]))
        assert one.apply(one.summary([start, start + values[1]]), [state[0], 3.0]) == one.run([start, start + values[1]], [state[0], 3.0])[1]
        one = scans.EarlyStop(draw.choice([2, 5, 40]), draw.choice([0.0, 0.5]))
        given = [state[0], 1.0, 1.0, 4.0, draw.choice([-1.0, -1.0, 2.0])]
        a, b = one.apply(one.summary(values), given), one.run(values, given)[1]
        assert (a[0], a[1], a[4]) == (b[0], b[1], b[4]) and (b[4] >= 0 or a == b)


def test_corners_stay_few():
    """States meet at the targets, so a map has a few corners and not one for each row."""
    draw = random.Random(3)
    summary = scans.StepLimit(1.0).summary([np.array([draw.uniform(-20, 20) for _ in range(5000)])])
    assert len(summary) < 200


def test_empty(spark):
    assert scans.step_limited(spark.createDataFrame([], ROWS), "item", ["at"], "value", 1.0, 0.0).count() == 0
    with pytest.raises(NotImplementedError):
        scans.Recurrence().summary([])
    assert F is not None


def test_a_stretch_just_long_enough_counts_at_any_time(spark, tmp_path):
    from speechmill.plans import sequences

    late = next(i for i in range(100_001, 200_000) if (i + 0.15) - i < 0.15)
    spark.createDataFrame([(late, 7, 75.0), (late + 1, 7, 74.99)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = sequences.character_spans(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(27)) and rows[0].start == late and rows[-1]["end"] == late + 0.15


def test_halves_round_by_their_product(spark):
    from speechmill.functions import numeric

    numbers = [s * (k + (10 * j + 5) / 1e6) for k in (0, 3, 75794) for j in range(400) for s in (1, -1)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", numeric.scaled_round(F.col("x"), 5).alias("r")).collect()
    half_up = lambda y: math.floor(y) + (y - math.floor(y) >= 0.5)
    assert all(r.r == math.copysign(half_up(abs(r.x) * 1e5) / 1e5, r.x) for r in rows)
