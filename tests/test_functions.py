import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from speechmill.functions import numeric, text
from speechmill.operators import checks, ranked, records, series


def one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_sanitize(spark):
    given = ["你好。。", "吧。，好", "真实。，", "吗？。", "，开头", "结尾，", "无标点", "", "等等……", "Hello.", None]
    assert one(spark, given, text.sanitize_punctuation) == ["你好。", "吧。好。", "真实。", "吗？", "开头。", "结尾。", "无标点。", "", "等等……", "Hello.。", ""]
    assert one(spark, ["Hello."], lambda c: text.sanitize_punctuation(c, True)) == ["Hello."]


def test_error_rate(spark):
    df = spark.createDataFrame([("abc", "abc"), ("", ""), ("", "x"), ("ab", "abcdefgh"), ("ＡＢ，c", "a b d"), ("é1", "e1")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(text.error_rate(F.col("a"), F.col("b"))).collect()] == [0, 0, 1, 1, 0.3333, 0.5]


def test_degenerate(spark):
    given = ["", "哈", "哈哈哈", "哈哈你", "a normal sentence here", "Thanks for watching", "abcdefgggggghijklmnop", "\n\t", "　\u00a0", "请不吝点赞订阅", "abab", "aab", "abcaaxyzaaq!"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = [r.why for r in text.with_degenerate_reason(df, "t", "why").orderBy("i").collect()]
    assert got == ["empty", "too_short", "single_character", "one_character_dominates", "", "stock_phrase", "", "empty", "empty", "stock_phrase", "one_character_dominates", "one_character_dominates", ""]
    strict = text.with_degenerate_reason(df.filter("i = 6"), "t", "why", strict_repeat=True).first().why
    assert strict == "repeated_character"


def test_sentences(spark):
    assert one(spark, ["One. c 3.14！ Two？！\n…\nthree；四", None], text.sentences) == [["One. c 3.14！", "Two？！", "three；", "四"], []]


def test_packing(spark):
    assert one(spark, ["一二三，四五，六七八九十，"], lambda c: text.pack_greedily(text.split_after_marks(c), 6)) == [["一二三，", "四五，", "六七八九十，"]]
    assert one(spark, ["a,b,c", ""], lambda c: text.pack_greedily(text.split_after_marks(c), 4)) == [["a,b,", "c"], []]


def test_small_text_functions(spark):
    assert one(spark, ["ju2", "lu4", "xuan1"], text.correct_pinyin) == ["JV2", "LU4", "XVAN1"]
    assert one(spark, ["你好world 1"], text.cjk_tokens) == [["你", "好", "WORLD", "1"]]
    assert one(spark, ["한국 か𠀀x"], text.cjk_tokens) == [["한", "국", "か", "𠀀", "X"]]
    assert one(spark, [" a/b:c "], text.safe_name) == ["a_b_c"]
    assert one(spark, ["Foo foobar"], lambda c: text.replace_terms(c, {"foo": "x", "foobar": "y$"})) == ["x y$"]
    got = one(spark, ["<|zh|><|HAPPY|><|Laughter|>hi  there<|BGM|>"], lambda c: text.rich_transcript(c, ("BGM", "Laughter"), {"SAD": "sad", "HAPPY": "happy"}))
    assert got[0].asDict() == {"text": "hi there。", "emotion": "happy", "events": ["BGM", "Laughter"]}


def test_numbers(spark):
    assert one(spark, ["-12，+12,0,19,x"], numeric.shift_list) == [[-12, 12]]
    assert one(spark, ["3,3,－2"], numeric.shift_list) == [[3, 3, -2]]
    given = ["[0,0,0,0,0,0,0,0.4]", "0,0,0,0,0,0,0", "[0.81,0,0,0,0,0,0,0]", "[NaN,0,0,0,0,0,0,0]", "x"]
    assert one(spark, given, numeric.emotion_vector) == [[0.0] * 7 + [0.4], None, None, None, None]
    toned = one(spark, ["[0,0,0.8,0,0,0,0,0]"], lambda c: numeric.tone_down(F.transform(numeric.emotion_vector(c), lambda x: x * 2)))
    assert toned[0] == pytest.approx([0, 0, 0.8, 0, 0, 0, 0, 0])


def naive_sanitize(t):
    """The rules as plain patterns, which take a long run's square in time."""
    t = t.strip()
    for pattern, by in (
        (r"([，。！？；、,.!?;:：])\1+", r"\1"), (r"\s*([。．.！!?？；;]+)[，,、]\s*", r"\1"), (r"\s*[，,、]\s*([。．.！!?？；;])", r"\1"),
        (r"([!?？；;])[。．]", r"\1"), (r"^[\s，。！？；、,.!?;:：]+", ""),
    ):
        t = re.sub(pattern, by, t)
    t = t.strip()
    if not t:
        return ""
    return t[:-1] + "。" if t[-1] in "，,、；;：:" else t if t[-1] in "。！？?!…" else t + "。"


def test_sanitize_is_the_plain_rule(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("a 。，.,!；、？\n啊") for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    assert one(spark, texts, text.sanitize_punctuation) == [naive_sanitize(t) for t in texts]


@pytest.mark.parametrize("middle", [" " * 100_000, "。.!" * 30_000, " ，" * 30_000, ",。 " * 30_000, "\u3000" * 50_000])
def test_long_runs_take_linear_time(spark, middle):
    given, began = ["a" + middle + "b"], time.time()
    assert one(spark, given, text.strip) == given
    one(spark, given, text.sanitize_punctuation)
    one(spark, given, lambda c: F.size(text.sentences(c)))
    assert time.time() - began < 6


def test_strip_knows_all_white_space(spark):
    every = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert one(spark, ["".join(every) + "a b" + "".join(every)], text.strip) == ["a b"]
    assert set(text.SPACES) == set(every)


def test_adjacency_of_nested_intervals(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0, "A"), (1, 1.0, 2.0, "A"), (1, 9.0, 11.0, "A"), (1, 11.01, 12.0, "A")], "g int, s double, e double, l string")
    assert [(r.s, r.e, r.n) for r in series.merge_adjacent(rows, "g", "s", "e", "l", 0.02).collect()] == [(0.0, 12.0, 4)]
    got = series.merge_adjacent(rows, "g", "s", "e", "l", 0.02, touching=True).orderBy("s").collect()
    assert [(r.s, r.e) for r in got] == [(0.0, 10.0), (1.0, 2.0), (9.0, 12.0)]


def test_as_of_keeps_a_matched_null(spark):
    right = spark.createDataFrame([(1, 2, 7.0), (1, 3, None)], "k int, at int, v double")
    got = series.as_of(spark.createDataFrame([(1, 1), (1, 2), (1, 5)], "k int, t int"), right, ["k"], "t", "at", "v").orderBy("t").collect()
    assert [r.v for r in got] == [None, 7.0, None]


def test_updates_do_not_hide_each_other(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    changes = spark.createDataFrame([(1, None, "B", 1), (1, "A", None, 2), (1, "Z", None, 3), (9, "q", "q", 4)], "id int, x string, y string, at int")
    assert sorted(map(tuple, records.update_fields(base, changes.drop("at"), "id").collect())) == [(1, "A", "B"), (2, "c", "d")]
    assert sorted(map(tuple, records.update_fields(base, changes, "id", "at").collect())) == [(1, "Z", "B"), (2, "c", "d")]


def test_missing_audio_comes_first(spark):
    rows = spark.createDataFrame([("", 5.0, True), ("x", -1.0, True), ("x", 5.0, None), ("x", 5.0, True)], "t string, s double, a boolean")
    verdict, problems = records.status(F.col("t"), F.col("s"), F.lit(30.0), F.lit(True), has_audio=F.col("a"))
    got = rows.select(verdict.alias("v"), problems.alias("p")).collect()
    assert [tuple(r) for r in got] == [("no_text", ["no_text"]), ("missing_audio", ["missing_audio"]), ("missing_audio", ["missing_audio"]), ("ready", [])]


def test_islands(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, "A"), (1, 1.01, 2.0, "A"), (1, 2.5, 3.0, "A"), (1, 3.0, 4.0, "B")], "g int, s double, e double, l string")
    got = series.merge_adjacent(rows, "g", "s", "e", "l", 0.02).orderBy("s").collect()
    assert [(r.s, r.e, r.l) for r in got] == [(0.0, 2.0, "A"), (2.5, 3.0, "A"), (3.0, 4.0, "B")]


def test_folds(spark):
    df = spark.createDataFrame([([-10.0, -10.0, -30.0],)], "v array<double>")
    assert df.select(series.step_limited(F.col("v"), 2.5, F.lit(-20.0))).first()[0] == [-20.0, -17.5, -20.0]
    df = spark.createDataFrame([([3.0, 2.0, 2.0, 2.1, 1.0],)], "v array<double>")
    assert tuple(df.select(series.early_stop(F.col("v"), 2, 1e-4)).first()[0]) == (2.0, 1, 3)


def test_suppression(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0, 3.0), (1, 3.9, 13.9, 2.0), (1, 4.1, 14.1, 1.0)], "g int, s double, e double, v double")
    assert {r.v for r in series.suppress_overlaps(rows, "g", "s", "e", "v", 0.6, 9).collect()} == {3.0, 1.0}


def test_fallback(spark):
    bank = spark.createDataFrame([("a", "happy", 1.0, 1), ("a", "happy", 2.0, 2), ("a", "sad", 3.0, 3)], "c string, e string, s double, id int")
    asked = spark.createDataFrame([("a", "happy"), ("a", "calm"), ("a", "angry"), ("b", "happy")], "c string, e string")
    got = records.pick_with_fallback(asked, bank, "c", "e", ["s"], "calm", ["id"]).collect()
    assert {(r.c, r.e): r.id for r in got} == {("a", "happy"): 2, ("a", "calm"): None, ("a", "angry"): 3, ("b", "happy"): None}


def test_best_of(spark):
    rows = spark.createDataFrame([("t", 0, 0.90), ("t", 1, 0.82), ("t", 2, 0.79), ("u", 0, -1.0)], "t string, k int, r double")
    assert [(r.t, r.k) for r in ranked.best_of(rows, "t", "r", "k").collect()] == [("t", 0)]


@pytest.mark.parametrize("n,val", [(1, 0), (2, 1), (50, 2)])
def test_split_sizes(spark, n, val):
    rows = spark.range(n).withColumn("g", F.lit(1))
    assert ranked.split_rows(rows, ["g"], F.col("id"), 0.05, 1).filter("part = 'val'").count() == val


def test_next_ids(spark):
    have = spark.createDataFrame([("utt_00007",), ("x",)], "id string")
    got = records.next_ids(spark.createDataFrame([("b",), ("a",)], "p string"), have, "id", ["p"]).orderBy("p").collect()
    assert [r.id for r in got] == ["utt_00008", "utt_00009"]


def test_repeat_cap(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, "a B ")], "i int, t string")
    key = F.lower(F.trim(F.regexp_replace("t", r"\s+", " ")))
    assert [r.over for r in records.keep_repeats(rows, key, ["i"], 2).orderBy("i").collect()] == [False, False, True]


def test_status(spark):
    df = spark.createDataFrame([("", 80.0, 30.0, True), ("x", 5.0, 30.0, True), ("x", 0.5, 30.0, True)], "t string, s double, n double, f boolean")
    first, every = records.status(F.col("t"), F.col("s"), F.col("n"), F.col("f"))
    assert [(r[0], r[1]) for r in df.select(first, every).collect()] == [("no_text", ["no_text", "over_hard_limit"]), ("ready", []), ("too_short", ["too_short"])]


def test_sung_transcripts(spark):
    words = [
        {"word": "b", "start_time": 0.5, "end_time": 1.0, "breathy": ["0", "1"]}, {"word": "愛", "start_time": 0.0, "end_time": 0.5, "breathy": "x"}, {"word": "人", "start_time": 1.0, "end_time": 1.5, "breathy": ["1"], "mix": []},
        {"word": "go", "start_time": 2.0, "end_time": 2.5, "mix": ["true"], "vibrato": ["1"]}, {"word": "", "start_time": 3.0}, {"word": "on", "start_time": 2.51, "end_time": 2.51, "mix": ["1"]}, {"word": "x", "start_time": 2.505, "end_time": 3.0, "mix": ["1.0"]},
    ]
    for w in words:
        w["breathy"] = w.get("breathy") if isinstance(w.get("breathy"), list) else None
    rows = spark.createDataFrame([(1, json.dumps(words)), (2, "no json"), (3, None), (4, "[]")], "k int, j string")
    sung = checks.sung_words(rows, "k", "j")
    assert {r.k: r.t for r in sung.select("k", checks.sung_text(F.col("words")).alias("t")).collect()} == {1: "愛 b 人 go x on", 2: "", 3: "", 4: ""}
    got = sorted(map(tuple, checks.technique_intervals(sung, "k").collect()))
    assert got == [(1, 0.5, 1.5, 3), (1, 2.0, 3.0, 1)]


def test_places_of_a_hot_group(spark):
    draw = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else draw.choice(["a", "b", None]), draw.choice([1.0, 2.5, None, draw.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(4)
    want = {}
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        want |= {r[0]: (n, len(mine)) for n, r in enumerate(mine, 1)}
    got = ranked.placed(df.withColumn("none", F.col("v").isNull()), ["g"], ["none", "v", "i"], range_rows=30)
    assert {r.i: (r.place, r.of) for r in got.collect()} == want
    held = {r.i for r in ranked.highest_share(df, "g", "v", "i", 0.1).filter("held_out").collect()}
    best = set()
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        best |= {r[0] for r in mine[: max(1, len(mine) // 10)]}
    assert held == best
