"""Queries that SQL can't express, over their whole tables, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from speechmill.functions import text as T
from speechmill.operators import records, sampling
from speechmill.plans import corpus, sequences, signals
from test_functions import naive_sanitize
from test_text_operators import plain_split, words


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_cer_adjacent_turns(spark, sf_dir):
    def plain(t):
        t = t.translate(str.maketrans(T.FULL_WIDTH, T.HALF_WIDTH))
        return re.sub(T.COMPARE_MARKS, "", t).lower()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    turns = {(r.conv_id, r.turn): r for r in table(spark, sf_dir, "conversations")}
    got = {(r.conv_id, r.turn): r.cer for r in corpus.cer_adjacent_turns(spark, sf_dir).collect()}
    pairs = [(k, r, turns[k[0], k[1] + 1]) for k, r in turns.items() if r.role == "user" and (k[0], k[1] + 1) in turns and turns[k[0], k[1] + 1].role == "assistant"]
    assert set(got) == {k for k, _, _ in pairs}
    for k, a, b in sorted(pairs, key=lambda p: len(p[1].text) * len(p[2].text))[:60]:  # the quadratic ones are left out of the plain version only
        a, b = plain(a.text), plain(b.text)
        want = 0.0 if a == b else 1.0 if not a else min(1.0, distance(a, b) / len(a))
        assert got[k] == pytest.approx(want, abs=1e-5)


def test_sanitize_punct(spark, sf_dir):
    source = {(r.conv_id, r.turn): naive_sanitize(r.text or "") for r in table(spark, sf_dir, "conversations")}
    assert {(r.conv_id, r.turn): r.clean for r in corpus.sanitize_punct(spark, sf_dir).collect()} == source


def test_greedy_pack(spark, sf_dir):
    got = {(r.conv_id, r.turn, r.pos): r.segment for r in corpus.greedy_pack(spark, sf_dir).collect()}
    want = {}
    for r in table(spark, sf_dir, "conversations"):
        out = []
        for part in filter(None, re.split(r"(?<=[，。！？、；：,.!?;:\n])", r.text)):
            if out and len(out[-1]) + len(part) <= 40:
                out[-1] += part
            else:
                out.append(part)
        want |= {(r.conv_id, r.turn, i): s for i, s in enumerate(out)}
    assert got == want


def test_nms_segments(spark, sf_dir):
    by_user = defaultdict(list)
    for r in table(spark, sf_dir, "events"):
        start = (r.ts.replace(tzinfo=__import__("datetime").timezone.utc)).timestamp()
        by_user[r.user_id].append((-r.value, start, start + r.value * 20_000, r.event_id))
    want = Counter()
    for user, rows in by_user.items():
        kept = []
        for _, a, b, event in sorted(rows):
            if len(kept) < 20 and all(min(b, d) - max(a, c) <= 0.6 * (b - a) for c, d in kept):
                kept.append((a, b))
                want[user, event] += 1
    got = Counter((r.user_id, r.event_id) for r in corpus.nms_segments(spark, sf_dir).collect())
    assert sum(((got - want) + (want - got)).values()) <= 0.001 * sum(want.values())  # ends that touch the limit may round


def test_stable_seeds(spark, sf_dir):
    got = {r.doc_id: r.seed for r in corpus.stable_seeds(spark, sf_dir).collect()}
    assert got == {r.doc_id: 42 + zlib.crc32(str(r.doc_id).encode()) % 100_000 for r in table(spark, sf_dir, "documents")}


def test_length_buckets(spark, sf_dir):
    most, by = 2, defaultdict(list)
    for r in table(spark, sf_dir, "conversations"):
        by[r.conv_id].append((len(r.text), r.turn))
    want = {}
    for conv, rows in by.items():
        rows.sort()
        if len(rows) <= most:
            want |= {(conv, turn): 0 for _, turn in rows}
            continue
        buckets = []
        for n, turn in rows:
            if n:
                if not buckets or len(buckets[-1]) == most or n >= int(1.5 * buckets[-1][len(buckets[-1]) // 2][0]):
                    buckets.append([])
                buckets[-1].append((n, turn))
        several, lonely = [b for b in buckets if len(b) > 1], [b[0] for b in buckets if len(b) == 1]
        for b in several:
            if len(b) < most and lonely:
                b.append(lonely.pop(0))
        several += [lonely[k : k + most] for k in range(0, len(lonely), most)]
        want |= {(conv, turn): i for i, b in enumerate(several) for _, turn in b}
    assert {(r.conv_id, r.turn): r.bucket for r in signals.length_buckets(spark, sf_dir).collect()} == want


def repaired(hz, tolerance=0.08, reach=80):
    voiced = [i for i, x in enumerate(hz) if x > 0]
    if len(voiced) < 5:
        return hz
    logs = [math.log2(hz[i]) for i in voiced]
    steps = [b - a for a, b in zip(logs, logs[1:], strict=False)]
    flat, done = list(steps), -1
    for i, step in enumerate(steps):
        if i > done and abs(abs(step) - 1) <= tolerance:
            for j in range(i + 1, min(len(steps), i + 1 + reach)):
                if abs(steps[j] + step) <= 2 * tolerance:
                    flat[i] = flat[j] = 0.0
                    done = j
                    break
    if done < 0:
        return hz
    common = lambda xs: min(Counter(round(x * 10) / 10 for x in xs).items(), key=lambda p: (-p[1], p[0]))[0]
    now, out = logs[0], [0.0] * len(hz)
    move = common(steps) - common(flat)
    for k, i in enumerate(voiced):
        now += flat[k - 1] if k else 0.0
        out[i] = 2 ** (now + move)
    return out


def test_octave_repair(spark, sf_dir):
    from speechmill.plans.media import _frames

    series = defaultdict(list)
    for r in _frames(spark, sf_dir).collect():
        series[r["item"]].append((r.pos, float(r.hz or 0.0)))
    got = {(r["item"], r.pos): r.hz for r in signals.octave_repair(spark, sf_dir).collect()}
    for item, rows in series.items():
        rows.sort()
        for (pos, _), hz in zip(rows, repaired([h for _, h in rows]), strict=True):
            assert got[item, pos] == pytest.approx(hz, rel=1e-6)


def test_token_segments(spark, sf_dir):
    from speechmill.functions import spans

    got = defaultdict(list)
    for r in sequences.token_segments(spark, sf_dir).orderBy("conv_id", "turn", "pos").collect():
        got[r.conv_id, r.turn].append(r.segment)
        assert r.tokens == words(r.segment)
    assert got == {(r.conv_id, r.turn): plain_split(r.text or "", words, 24, spans.TERM) for r in table(spark, sf_dir, "conversations")}


def test_cuts_and_repeats_of_hot_keys(spark):
    draw = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else f"k{draw.randint(0, 30)}", draw.choice(["", "bad"])) for i in range(900)] + [(900, None, ""), (901, None, "")]
    df = spark.createDataFrame(rows, "i int, k string, r string").repartition(5)
    seen, want = Counter(), {}
    for i, k, r in rows:
        seen[k] += r == ""
        want[i] = "text: bad" if r else "repeats over the limit" if seen[k] > 4 else ""
    got = records.curate(df, F.col("r"), F.lit(1.0), 0.0, F.col("k"), ["i"], 4)
    assert {r.i: r.drop_reason for r in got.collect()} == want
    hashes = spark.createDataFrame([(i, f"{draw.randint(0, 2**16):032x}" if i % 2 else f"{i:032x}"[::-1]) for i in range(500)], "i int, h string")
    order = [r.i for r in sorted(hashes.collect(), key=lambda r: (r.h, r.i))]
    for n in (0, 1, 77, 250, 499, 500, 600):
        assert sorted(r.i for r in sampling.least_hashes(hashes, "h", "i", n, 10).collect()) == sorted(order[:n])
