"""Gates, waves and series repairs on hand-made rows: nulls, ends, short series."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from speechmill.operators import frames, gates, waves


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in values)) if values else spark.range(1)
    return row.select(*columns).first()


TYPES = {"text": "string", "n": "double", "wave": "array<double>", "other": "array<double>"}


@pytest.mark.parametrize(
    ("label", "key"), [("生气/angry", "angry"), (" happy ", "happy"), ("sadness", "sad"), ("<unk>", ""), ("bored", ""), (None, "")]
)
def test_labels_are_found_by_name_or_beginning(spark, label, key):
    assert one(spark, gates.label_key(F.lit(label).cast("string")))[0] == key


@pytest.mark.parametrize(
    ("text", "chinese"), [("你好 world", True), ("12, 34", True), ("me1@here.org", True), ("say xuan4 now", True), ("plain words 4", False), ("axuan4", False)]
)
def test_languages_are_routed(spark, text, chinese):
    assert one(spark, gates.speaks_chinese(F.lit(text)))[0] is chinese


def test_lines_stay_within_bounds(spark):
    line = gates.clamped_line(F.lit("bored"), F.lit(None).cast("double"), F.lit(9000), F.array(*map(F.lit, ("b", "x", "a", "c"))), F.lit(" a b c "), ("calm", "sad"))
    row = one(spark, *line)
    assert (row.emotion, row.intensity, row.pause_ms, row.text, row.stressed) == ("calm", 0.5, 3000, "a b c", ["b", "a"])


def test_verdicts_before_transcription(spark):
    got = [one(spark, gates.transcribe_verdict(F.lit(t).cast("string"), F.lit(d).cast("double")))[0] for t, d in (("x", 5), (None, None), (" ", 20), ("", 20.5), (None, 0.5))]
    assert got == ["kept_existing", "trainable", "trainable", "untrainable", "untrainable"]


def test_fade_of_equal_power_and_short_waves(spark):
    a, b = [1.0] * 6, [1.0] * 5
    faded = one(spark, waves.crossfaded(F.col("wave"), F.col("other"), 3), wave=a, other=b)[0]
    assert len(faded) == 8 and faded[4] == pytest.approx(math.sqrt(2)) and faded[3] == pytest.approx(1) and faded[:3] == [1, 1, 1]
    assert one(spark, waves.crossfaded(F.col("wave"), F.col("other"), 5), wave=a, other=b)[0] == a + b
    assert one(spark, waves.crossfaded(F.col("wave"), F.col("other"), 3), wave=[], other=b)[0] == b


def test_segments_out_of_range_are_errors(spark):
    assert one(spark, waves.segment(F.col("wave"), 1, 3), wave=[1.0, 2.0, 3.0])[0] == [2.0, 3.0]
    with pytest.raises(Exception, match="no samples 1 to 4"):
        one(spark, waves.segment(F.col("wave"), 1, 4), wave=[1.0, 2.0, 3.0])


def test_silence_stays_silence(spark):
    assert one(spark, waves.anchored(F.col("wave"), -30.0, -10.0, 5.0), wave=[0.0, 0.0])[0] == [0.0, 0.0]
    assert one(spark, waves.at_level(F.col("wave"), -20.0), wave=[0.0])[0] == [0.0]
    assert one(spark, waves.trimmed(F.col("wave"), 0.5, 1), wave=[0.0, 0.0, 0.9, 0.0, 0.0])[0] == [0.0, 0.9, 0.0]


def test_peaks_stay_under_the_ceiling(spark):
    loud = one(spark, waves.at_level(F.col("wave"), 0.0), wave=[0.1, -0.9])[0]
    assert max(map(abs, loud)) == pytest.approx(10 ** (-1 / 20))


def test_regridding_does_not_bridge_unvoiced_frames(spark):
    frames = spark.createDataFrame([("a", k, hz) for k, hz in enumerate([100.0, 100.0, 0.0, 0.0, 200.0, 200.0])], "item string, pos int, hz double")
    lengths = spark.createDataFrame([("a", 11), ("absent", 3)], "item string, places int")
    got = [r.hz for r in waves.regridded(frames, lengths).orderBy("place").collect()]
    assert got == [100, 100, 100, 50, 0, 0, 0, 100, 200, 200, 200]


def test_silent_runs_shrink_only_in_items_with_many(spark):
    rows = [("a", k, "s") for k in range(4)] + [("a", 4, "x")] + [("a", 5 + k, "s") for k in range(3)] + [("b", k, "s") for k in range(3)]
    codes = spark.createDataFrame(rows, "item string, pos int, code string")
    got = sorted((r.item, r.pos) for r in waves.shrink_silences(codes, F.col("code") == "s", 2, 5).collect())
    assert got == [("a", 0), ("a", 1), ("a", 4), ("a", 5), ("a", 6), ("b", 0), ("b", 1), ("b", 2)]


def test_folders_fall_back_to_all_files(spark):
    files = spark.createDataFrame([("en/1",), ("de/2",), ("readme",)], "path string")
    folder = F.when(F.contains("path", F.lit("/")), F.split("path", "/")[0]).otherwise("")
    assert sorted(r.path for r in gates.plan_by_folder(files, folder, ["en"], "").collect()) == ["en/1", "readme"]
    assert gates.plan_by_folder(files, folder, ["it"], "").count() == 3


def test_checkpoints_near_an_onset_that_is_never_reached(spark):
    rows = spark.createDataFrame([("a", s, o) for s, o in ((10, 99), (20, 99), (30, 99))] + [("b", s, 10) for s in (10, 20, 30)], "run string, step int, onset int")
    got = sorted((r.run, r.step) for r in gates.near_onset(rows, "run", "step", "onset", 2).collect())
    assert got == [("a", 20), ("a", 30), ("b", 10), ("b", 20)]


def test_lengths_are_dealt_to_buckets(spark):
    from speechmill.operators.packing import _buckets, length_buckets

    assert _buckets([0, 10, 11, 14, 15, 40, 90], 4) == [[1, 2, 3, 4], [5, 6]]
    assert _buckets([10, 11, 40], 2) == [[0, 1], [2]] and _buckets([10, 11, 40, 90], 3) == [[0, 1, 2], [3]]
    rows = spark.createDataFrame([("a", k, n) for k, n in enumerate([90, 10, 0, 11, 40])] + [("b", 0, 0), ("b", 1, 7)], "item string, seq int, n int")
    got = {}
    for r in length_buckets(rows, "item", "seq", "n", 3).collect():
        got.setdefault((r.item, r.bucket), set()).add(r.seq)
    assert got == {("a", 0): {1, 3, 4}, ("a", 1): {0}, ("b", 0): {0, 1}}


def test_octave_errors_are_undone_and_lasting_leaps_stay(spark):
    from speechmill.operators.packing import octave_repair

    error = [100.0, 101.0, 0.0, 202.0, 203.0, 101.5, 100.0, 100.0]
    leap = [100.0] * 4 + [200.0] * 8
    rows = [("e", k, x) for k, x in enumerate(error)] + [("l", k, x) for k, x in enumerate(leap)] + [("s", 0, 50.0), ("s", 1, None)]
    got = {}
    for r in octave_repair(spark.createDataFrame(rows, "item string, pos int, hz double"), reach=3).orderBy("item", "pos").collect():
        got.setdefault(r.item, []).append(r.hz)
    assert got["l"] == leap and got["s"] == [50.0, 0.0]
    assert got["e"][2] == 0 and max(got["e"]) < 110 and min(x for x in got["e"] if x) > 95


def test_health_of_levels_and_waves(spark):
    rows = [("a", 0, -60.0), ("a", 1, -10.0), ("a", 2, -20.0), ("a", 3, -50.0), ("b", 0, -30.0), ("b", 1, None), (None, 0, 1.0)]
    got = {r.item: r for r in frames.level_health(spark.createDataFrame(rows, "item string, pos int, db double")).collect()}
    assert set(got) == {"a", "b"} and got["b"].snr_db == 60 and got["b"].silence_ratio == 0
    a = got["a"]
    assert (a.silence_ratio, a.dynamic_range_db, a.snr_db) == (0.5, 50, 40) and (a.leading_silence, a.trailing_silence) == pytest.approx((0.01, 0.01))
    df = spark.createDataFrame([(1, [1.0, -0.5, 0.0, 0.0]), (2, []), (3, None), (4, [0.0])], "id int, w array<double>")
    told = {r.id: r for r in df.select("id", *waves.wave_health(F.col("w"))).collect()}
    assert (told[1].peak_dbfs, told[1].clip_ratio, told[1].dc_offset) == (0, 0.25, 0.125) and told[4].rms_dbfs == pytest.approx(-200)
    assert told[2].peak_dbfs is None and told[3].rms_dbfs is None and told[3].dc_offset is None


def test_long_waves_are_moved_in_linear_time(spark):
    wave = [math.sin(i / 5) / 2 for i in range(3000)]
    level = 20 * math.log10(math.sqrt(sum(x * x for x in wave) / len(wave)))
    begun = time.monotonic()
    got = one(spark, waves.anchored(F.col("wave"), -30.0, -20.0, 5.0), wave=wave)[0]
    assert got == pytest.approx([x * 10 ** ((-20.0 + 5.0 - level) / 20) for x in wave])
    assert time.monotonic() - begun < 30


def test_long_waves_are_levelled_in_linear_time(spark):
    wave = [math.sin(i / 5) / 2 for i in range(3000)]
    level = 20 * math.log10(math.sqrt(sum(x * x for x in wave) / len(wave)))
    begun = time.monotonic()
    loud = one(spark, waves.at_level(F.col("wave"), -1.0), wave=wave)[0]
    assert max(map(abs, loud)) == pytest.approx(10 ** (-1 / 20))
    assert one(spark, waves.at_level(F.col("wave"), -20.0), wave=wave)[0] == pytest.approx([x * 10 ** ((-20.0 - level) / 20) for x in wave])
    assert time.monotonic() - begun < 30


def test_ties_with_a_quantile_fall_as_in_sql(spark):
    """The 60th percentile between 8.94 and 10.89, less 24 dB, is -13.89 and a last bit; a frame at -13.89 is heard."""
    hz_db = [(100.0, v) for v in (20.0, 21.0, 22.0, 23.0)] + [(55.0, 58.94 - 50), (55.0, 10.89), (50.0, -13.89)] + [(100.0, -40.0)] * 5
    rows = spark.createDataFrame([(1, i, hz, db) for i, (hz, db) in enumerate(hz_db)], "item int, pos int, hz double, db double")
    assert waves.final_creak(rows).first().score == 0.225
    draw = random.Random(5)
    series = [(k, i, round(draw.uniform(0, 100), 2)) for k in range(300) for i in range(draw.randint(1, 30))]
    got = {r["item"]: (r.n, r.quantile) for r in frames.quantiles(spark.createDataFrame(series, "item int, pos int, v double"), "v", 0.1).collect()}
    for k in range(300):
        values = sorted(v for item, _, v in series if item == k)
        at = (len(values) - 1) * 0.1
        low, high, d = values[math.floor(at)], values[math.ceil(at)], at - math.floor(at)
        assert got[k] == (len(values), math.fma(low, 1 - d, high * d) if d else low)


def test_addresses_that_differ_by_a_slash_are_two_pages(spark, tmp_path):
    from speechmill.plans import signals

    pages = [(1, "http://a.org/x/", "short"), (2, "http://a.org/x", "long" * 600), (3, "http://a.org//x", "short"), (4, None, "long" * 600), (5, "http://a.org/y/", "long" * 600), (6, "http://a.org/y/", "short"), (7, ".", "long" * 600)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in signals.path_conflicts(spark, str(tmp_path)).collect()) == [2, 5, 6, 7]
