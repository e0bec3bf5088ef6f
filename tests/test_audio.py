"""Audio files: round trips, broken files, failed tasks; spectra against direct sums; windows and glossaries by brute force."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmill.operators import glossary, segments, spectra
from speechmill.sources import audio

SEGMENTS = "item string, pos int, samples array<double>, silence_after_ms int"


def files(spark, folder):
    return spark.read.format("binaryFile").load(f"{folder}/*")


def test_segments_round_trip(spark, tmp_path):
    draw = np.random.default_rng(1)
    rows = [(item, pos, (draw.uniform(-0.9, 0.9, n)).tolist(), pause) for item, parts in {"a": [(5, 10), (0, None), (7, 0)], "b": [(3, 250)]}.items() for pos, (n, pause) in enumerate(parts)]
    audio.write_wavs(spark.createDataFrame(rows[::-1], SEGMENTS).repartition(3), str(tmp_path / "out"), 1000)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.wav", "b.wav"]
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.waves(files(spark, tmp_path / "out")).collect()}
    want = {"a.wav": rows[0][2] + [0.0] * 10 + rows[2][2], "b.wav": rows[3][2] + [0.0] * 250}
    for name, samples in want.items():
        assert got[name].rate == 1000 and got[name].wave == pytest.approx(samples, abs=1e-4)
    seconds = {r.path.rsplit("/", 1)[1]: r.seconds for r in audio.durations(spark, str(tmp_path / "out")).collect()}
    assert seconds == {name: len(s) / 1000 for name, s in want.items()}


def test_headers(spark, tmp_path):
    odd = struct.pack("<4sI4s4sI3sx4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"LIST", 3, b"abc", b"fmt ", 16, 1, 2, 8000, 32000, 4, 16, b"data", 0xFFFFFFFF) + bytes(32000)
    flac = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + bytes(16)
    for name, content in {"odd.wav": odd, "x.flac": flac, "cut.wav": odd[:30], "text.wav": b"hello"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.seconds, r.rate, r.channels) for r in audio.durations(spark, str(tmp_path)).collect()}
    assert got == {"odd.wav": (1.0, 8000, 2), "x.flac": (2.0, 44100, 2), "cut.wav": (-1.0, None, None), "text.wav": (-1.0, None, None)}
    assert [r.wave for r in audio.waves(files(spark, tmp_path)).filter("path like '%text.wav'").collect()] == [None]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", 0, [0.1] * 10, 0) for k in range(20)], SEGMENTS)
    broken = rows.withColumn("samples", F.when(F.col("item") == "i7", F.expr("transform(samples, x -> cast(raise_error('no') as double))")).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="no"):
        audio.write_wavs(broken, str(tmp_path / "out"), 100)
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_short_writes_are_refused(tmp_path):
    import pyarrow as pa

    writer = audio._Writer({"path": str(tmp_path / "out"), "rate": "100"})
    batch = pa.RecordBatch.from_pylist([{"item": "a", "total": 5, "samples": [0.0], "silence": 1}])
    with pytest.raises(ValueError, match="fewer"):
        writer.write(iter([batch]))
    assert list((tmp_path / "out").iterdir()) == []
    done = writer.write(iter([pa.RecordBatch.from_pylist([{"item": "a", "total": 2, "samples": [0.0], "silence": 1}])]))
    writer.abort([done, None])
    assert list((tmp_path / "out").iterdir()) == []


def direct(wave, n_fft, hop):
    window = np.hanning(n_fft)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n_fft // 2 + 1), np.arange(n_fft)) / n_fft)
    starts = range(0, max(1, len(wave) - n_fft), hop)
    return np.array([np.abs(turn @ (np.pad(wave[s : s + n_fft], (0, max(0, n_fft - len(wave[s : s + n_fft])))) * window)) ** 2 for s in starts])


@pytest.mark.parametrize("n", [10, 64, 65, 300, 5000])
def test_powers_are_those_of_a_direct_sum(n, monkeypatch):
    monkeypatch.setattr(spectra, "FRAMES", 7)
    wave = np.random.default_rng(n).normal(size=n)
    assert np.allclose(np.concatenate(list(spectra.frame_powers(wave, 64, 16))), direct(wave, 64, 16))


def test_profiles_of_ragged_waves(spark):
    rate = 8000.0
    tone = lambda hz, n: np.sin(2 * np.pi * hz * np.arange(n) / rate).tolist()
    rows = [(1, tone(500, 8000)), (2, [0.0] * 4000 + tone(2000, 4000)), (3, tone(500, 100)), (4, None), (5, [])]
    got = {r.i: r for r in spectra.band_profiles(spark.createDataFrame(rows, "i int, wave array<double>"), "i", "wave", rate).collect()}
    assert got[1].bands[1] > 99 and abs(got[1].centroid - 500) < 5 and got[2].bands[2] > 98 and abs(got[2].centroid - 2000) < 40
    assert [got[k].bands for k in (3, 4, 5)] == [None] * 3
    levels = spectra.band_levels(spark.createDataFrame(rows, "i int, wave array<double>"), "i", "wave", rate)
    assert {r.i: r.n for r in levels.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 12, 2: 12, 3: 1}


def test_best_windows_are_those_of_all(spark):
    """The ranks that go to a task hold every window that the choice over all takes."""
    draw = random.Random(5)
    rows = [(item, 4 * k, 24, draw.choice([draw.uniform(0, 100), 50.0 + k % 3])) for item in ("hot", "b") for k in range(400 if item == "hot" else 30)]
    df = spark.createDataFrame(rows, "item string, first long, frames long, score double")
    got = {(r.item, r.first) for r in segments.best_windows(df, 24, 4).collect()}
    want = set()
    for item in ("hot", "b"):
        kept = []
        for _, first, frames, _ in sorted((r for r in rows if r[0] == item), key=lambda r: (-r[3], r[1])):
            if len(kept) < 8 and all(min(first + frames, k + frames) - max(first, k) <= 0.6 * frames for k in kept):
                kept.append(first)
        want |= {(item, k) for k in kept}
    assert got == want


def test_one_edit_apart(spark):
    draw = random.Random(6)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 8))) for _ in range(250)] + ["", "aaaaaa", "aaaaa", "aaaaaaa"]
    names = words[::5] + ["aaaaaa"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        return row[-1]

    want = {(w, n) for w in words for n in names if w and n and (w == n or len(n) >= 6 and distance(w, n) <= 1)}
    got = glossary.similar_readings(spark.createDataFrame([(w,) for w in words], "heard string"), spark.createDataFrame([(n,) for n in names], "reading string"))
    assert {tuple(r) for r in got.select("heard", "reading").collect()} == want and got.count() == len(want)


def _shuffled(spark, query) -> tuple[list, int]:
    """Rows of a query that hasn't run yet, and the records that its stages shuffle."""
    context = spark.sparkContext
    new = lambda: context._jvm.java.util.ArrayList()
    stages = lambda: context._jsc.sc().statusStore().stageList(new(), False, False, context._gateway.new_array(context._jvm.double, 0), new())
    before = max([-1, *(stages().apply(i).stageId() for i in range(stages().size()))])
    rows = [tuple(r) for r in query.collect()]
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    after = stages()
    return rows, sum(x.shuffleWriteRecords() for x in map(after.apply, range(after.size())) if x.stageId() > before)


def test_only_windows_near_a_name_are_shuffled(spark):
    draw = random.Random(5)
    lines = [(i, ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(40)]) for i in range(100)]
    lines += [(100, ["xyzxyz", "xyyxyz", "a"]), (101, ["ab", "xyzxyz", "xyzxyz"])]
    text = spark.createDataFrame(lines, "i int, u array<string>").withColumn("r", F.col("u"))
    names = glossary.glossary(spark.createDataFrame([(1, ["xyzxyz", "xyzxyz"])], "at int, u array<string>"), F.col("u"), F.col("u"), "at")
    rows, records = _shuffled(spark, glossary.matches(text, ["i"], "u", "r", names))
    assert rows == [(100, 0, 2, "xyzxyz xyyxyz", "xyzxyz xyzxyz")] and 0 < records < 100  # of 7,700 windows


def test_matches_as_all_windows_by_all_names(spark):
    draw = random.Random(8)
    sound = str.maketrans("áéôß", "aeoo")
    words = ["".join(draw.choice("abáéôß") for _ in range(draw.randint(0, 4))) for _ in range(40)]
    lines = [(i, None if i == 7 else [draw.choice(words) for _ in range(draw.randint(0, 9))]) for i in range(150)]
    listed = [(i, [draw.choice(words) for _ in range(draw.randint(1, 4))]) for i in range(30)]
    listed += [(30 + i, u[j : j + 3]) for i, (u, j) in enumerate((lines[k][1], draw.randint(0, 3)) for k in range(10, 40)) if u]  # said in a line, and of the same reading
    listed += [(60 + i, [w.replace("á", "a") for w in u]) for i, u in listed[30:]]
    names = {}
    for at, u in listed:
        if "".join(u):
            names.setdefault(" ".join(u), (at, len(u), "".join(u).translate(sound)))

    def near(a, b):
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a == b or len(b) >= 6 and (a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:])

    want = set()
    for i, u in lines:
        found = []
        for name, (at, n, reading) in names.items():
            for rank, w in enumerate((n, n + 1, n - 1)):
                for pos in range(len(u or []) - w + 1 if w >= 2 else 0):
                    said, heard = " ".join(u[pos : pos + w]), "".join(u[pos : pos + w]).translate(sound)
                    if heard and said != name and near(heard, reading):
                        found.append((at, rank, pos, w, said, name))
        want |= {(i, *min(found)[2:])} if found else set()
    assert len(want) > 50
    read = lambda u: F.transform(u, lambda x: F.translate(x, "áéôß", "aeoo"))
    text = spark.createDataFrame(lines, "i int, u array<string>").repartition(3)
    table = glossary.glossary(spark.createDataFrame(listed, "at int, u array<string>"), F.col("u"), read(F.col("u")), "at")
    for most in (glossary.MOST_OFFERS, 5):  # looked up, and joined
        got = glossary.matches(text.withColumn("r", read(F.col("u"))), ["i"], "u", "r", table, most_offers=most)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert glossary.matches(text.withColumn("r", read(F.col("u"))), ["i"], "u", "r", table.limit(0)).collect() == []


def test_glossary_replaces_the_first_match(spark):
    text = spark.createDataFrame([(1, list("哈提西亚对他说")), (2, list("卡提希娅来了")), (3, list("好"))], "i int, u array<string>")
    sounds = {"哈": "ka", "卡": "ka", "提": "ti", "西": "xi", "希": "xi", "亚": "ya", "娅": "ya"}
    reading = F.transform("u", lambda c: F.coalesce(F.create_map(*[F.lit(x) for p in sounds.items() for x in p])[c], F.lit("zzz")))
    names = glossary.glossary(spark.createDataFrame([(1, list("卡提希娅"))], "at int, u array<string>"), F.col("u"), reading, "at")
    found = text.join(glossary.matches(text.withColumn("r", reading), ["i"], "u", "r", names), "i", "left")
    got = found.select("i", F.array_join(glossary.replaced(F.col("u"), F.col("pos"), F.col("width"), F.col("name")), "").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["卡 提 希 娅对他说", "卡提希娅来了", "好"]
