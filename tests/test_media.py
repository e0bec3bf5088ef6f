from pyspark.sql import functions as F

from speechmill.operators import catalog, frames, records, sampling, scripts


def test_guess_emotion_and_stress(spark):
    lines = ["对不起，再见", "太好了！", "什么？", "好。", "孤独", "Yes!", "what?", "so…", "救命啊！！", "不是很好"]
    emotion, strength = scripts.guess_emotion(F.col("t"))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").orderBy("i").select(emotion, strength, scripts.stressed_words(F.col("t")))
    assert [tuple(r)[:2] for r in got.collect()] == [("sad", 0.8), ("happy", 0.8), ("surprised", 0.65), ("calm", 0.35), ("sad", 0.65), ("happy", 0.5), ("surprised", 0.5), ("melancholic", 0.45), ("afraid", 0.95), ("calm", 0.35)]
    assert [r[2] for r in got.collect()][-2:] == [[], ["不", "很"]]


def test_pauses_keep_their_bands(spark):
    lines = ["一，", "一。", "一！", "一……", "一——", "一、", "一"]
    for jitter in (0.85, 1.15):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").orderBy("i")
        got = [r[0] for r in df.select(scripts.pause_after(F.col("t"), F.lit("sad"), F.lit(jitter))).collect()]
        bands = [(120, 210), (320, 450), (260, 380), (580, 820), (480, 640), (100, 170), (320, 450)]
        assert all(lo <= g <= hi for g, (lo, hi) in zip(got, bands, strict=True))
    got = [r[0] for r in df.select(scripts.least_pause(F.col("t"))).collect()]
    assert got == [260, 320, 260, 580, 480, 260, 0]


def test_merge_blocks(spark):
    rows = [(1, i, t, e, 3) for i, (t, e) in enumerate([("一二三", "calm"), ("四。", "calm"), ("五", "sad"), ("六……", "sad"), ("七", "sad"), ("x" * 36, "sad"), ("y" * 3, "sad")])]
    got = scripts.merge_blocks(spark.createDataFrame(rows, "k int, pos long, line string, emotion string, tokens int"), "k", "pos")
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, 2, 6, 6), (2, 2, 6, 5), (4, 2, 6, 38), (6, 1, 3, 3)]


def test_intervals_and_matches(spark):
    rows = spark.createDataFrame([(1, 0, 0, 3, "a"), (1, 1, 2, 2, "b"), (1, 2, 9, 0, "c")], "item int, seq int, first long, length long, label string")
    assert sorted(tuple(r) for r in frames.frames_of_intervals(rows).collect()) == [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "b")]
    wanted = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.1), (1, 3, 9.0)], "item int, seq long, at double")
    there = spark.createDataFrame([(1, 1.05), (1, 1.3), (1, 5.0)], "item int, start double")
    assert sorted(tuple(r) for r in frames.nearest_unused(wanted, there, 0.38).collect()) == [(1, 1, 1.05), (1, 2, 1.3)]


def test_versions_and_ladders(spark):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(["1.10", "1.9.x", None, "2"])], "i int, v string").orderBy("i")
    assert [r[0] for r in got.select(catalog.version_fits(F.col("v"), ">=1.9.1")).collect()] == [True, False, False, True]
    assert [r[0] for r in got.select(catalog.version_fits(F.col("v"), "1.*")).collect()] == [True, True, False, False]
    minutes = spark.createDataFrame([(i, m) for i, m in enumerate([1.0, 5.0, 8.0, 30.0])], "i int, m double").orderBy("i")
    assert [r[0][0] for r in minutes.select(sampling.preset_ladder(F.col("m"))).collect()] == ["conservative", "balanced", "expressive", "expressive"]


def test_next_ids_are_distinct(spark):
    have = spark.createDataFrame([("utt_00007",)], "id string")
    got = records.next_ids(spark.range(60_000).repartition(7).withColumnRenamed("id", "n"), have, "id", ["n"], parts=5)
    row = got.agg(F.countDistinct("id").alias("ids"), F.min("id").alias("lo"), F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("long")).alias("hi")).first()
    assert (row.ids, row.lo, row.hi) == (60_000, "utt_00008", 60_007)
