"""Sessions as real streams: order, repeats, ends, timers, and what state is left."""

import random
import time

import numpy as np
import pytest

from speechmill.streaming import sessions
from speechmill.streaming.windows import Chunker

ROWS = "session string, seq long, samples array<double>, last boolean"


def stream_of(spark, source):
    source.mkdir()
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(source))


def put(spark, rows, source):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(str(source))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(spark, tmp_path, batches, make):
    """Each batch is a file that a micro-batch reads; the rows that came out, and the checkpoint."""
    stream = stream_of(spark, tmp_path / "in")
    for rows in batches:
        put(spark, rows, tmp_path / "in")
    sink, check = str(tmp_path / "out"), str(tmp_path / "check")
    query = make(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(sink)
    assert query.awaitTermination(120)
    return spark.read.parquet(sink).collect(), check


def left(spark, check, name):
    return spark.read.format("statestore").option("stateVarName", name).load(check).count()


def test_chunks_of_a_stream(spark, tmp_path):
    """Pieces out of order over micro-batches, some twice: the blocks of all samples; ended sessions leave no state."""
    draw = random.Random(1)
    sizes = {"a": [3, 8, 0, 5, 9], "b": [20, 1, 1, 7], "open": [4, 4]}
    pieces, whole = [], {}
    for name, parts in sizes.items():
        at = 0
        for seq, n in enumerate(parts):
            pieces.append((name, seq, [float(x) for x in range(at, at + n)], seq == len(parts) - 1 and name != "open"))
            at += n
        whole[name] = [float(x) for x in range(at)]
    draw.shuffle(pieces)
    batches = [pieces[:4], pieces[4:7] + pieces[:2], pieces[7:]]
    got, check = run(spark, tmp_path, batches, lambda s: sessions.chunked(s, 6, 2, 1))
    for name, samples in whole.items():
        chunker = Chunker(6, 2, 1)
        want = list(chunker.feed(samples)) + (list(chunker.finish()) if name != "open" else [])
        assert sorted((r.start, list(r.samples), r.lead) for r in got if r.session == name) == sorted(want), name
    assert left(spark, check, "held") == 1 and left(spark, check, "turn") == 1 and left(spark, check, "waiting") == 0


def joined(pieces, overlap, fade):
    """All pieces at once."""
    out = np.array(pieces[0], float)
    for piece in pieces[1:]:
        piece = np.array(piece, float)
        n = min(overlap, len(out), len(piece))
        window = np.hanning(2 * n)
        out = np.concatenate([out[: len(out) - n], out[len(out) - n :] * window[n:] + piece[:n] * window[:n], piece[overlap:]])
    if len(out) > fade:
        out[len(out) - fade :] *= np.linspace(1, 0, fade)
    return out.tolist()


def test_overlap_add_of_a_stream(spark, tmp_path):
    draw = np.random.default_rng(2)
    pieces = {name: [draw.normal(size=12).tolist() for _ in range(5)] for name in ("a", "b")}
    rows = [(n, k, p, k == 4) for n, ps in pieces.items() for k, p in enumerate(ps)]
    got, check = run(spark, tmp_path, [rows[5:8] + rows[1:3], rows[:1] + rows[8:], rows[3:5] + rows[3:4]], lambda s: sessions.overlap_added(s, 4, 3))
    for name, ps in pieces.items():
        mine = sorted((r for r in got if r.session == name), key=lambda r: r.start)
        assert [r.start for r in mine] == np.cumsum([0, *(len(r.samples) for r in mine[:-1])]).tolist()
        assert [x for r in mine for x in r.samples] == pytest.approx(joined(ps, 4, 3))
        assert [r.done for r in mine] == [False] * (len(mine) - 1) + [True]
    assert left(spark, check, "held") == left(spark, check, "turn") == left(spark, check, "waiting") == 0


def test_idle_sessions_end_by_timer(spark, tmp_path):
    """A session that stays silent gives out what it holds, without the piece that never came, and is forgotten."""
    stream = stream_of(spark, tmp_path / "in")
    a = [("a", 0, [1.0] * 8, False), ("a", 2, [3.0] * 8, False)]
    put(spark, a, tmp_path / "in")
    query = sessions.overlap_added(stream, 2, 1000, idle_ms=300).writeStream.outputMode("append").format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        until, mine = time.time() + 60, []
        while time.time() < until and not (mine and mine[-1].done):
            time.sleep(0.5)
            mine = sorted(spark.table("joined").collect(), key=lambda r: r.start)
    finally:
        query.stop()
    assert [x for r in mine for x in r.samples] == pytest.approx(joined([a[0][2], a[1][2]], 2, 1000))
    assert mine[-1].done and left(spark, str(tmp_path / "check"), "held") == 0


def test_short_pieces():
    machine, state, out = sessions.OverlapAdd(4, 2), None, []
    for k, piece in enumerate(([1.0, 1.0], [2.0] * 6, [], [4.0])):
        rows, state = machine.feed(state, piece, k == 3)
        out += [x for r in rows for x in r[1]]
    assert len(out) == 6 and machine.finish(None) == []
