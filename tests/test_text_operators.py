"""Protected spans, token budgets, maps with errors, SQL functions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from speechmill.functions import emotions, spans, sql
from speechmill.operators import token_packing as packing


def one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_spans_are_those_of_the_plain_patterns(spark):
    draw = random.Random(2)
    bits = ["a", "B7", "-", "@", ".", "c", "9", "行", "·", "—", "<", "|", ">", " ", "x-y", "\n", spans.MASK]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 16))) for _ in range(3000)] + ["a@b.cd1@e.fg", "GPT-5-nano 克里斯托弗·诺兰", ""]
    plain = "|".join((spans.MASK, *spans.PATTERNS))
    assert one(spark, texts, spans.spans) == [[m[0] for m in re.finditer(plain, t)] for t in texts]
    assert one(spark, texts, lambda c: spans.restored(spans.masked(c), spans.spans(c))) == texts


def test_lost_masks_are_told(spark):
    assert one(spark, ["x-y z", None], lambda c: spans.restored(F.replace(spans.masked(c), F.lit(spans.MASK), F.lit("")), spans.spans(c))) == [None, ""]


@pytest.mark.parametrize("text", ["a" * 100_000, "行" * 100_000, "a@" * 50_000, "<a" * 50_000, "a-" * 50_000, "1a" * 3000])
def test_spans_take_linear_time(spark, text):
    began = time.time()
    one(spark, [text], lambda c: F.size(spans.spans(c)))
    assert time.time() - began < 6


def test_annotations(spark):
    given = ["<going|g ow1 . ih0 ng> on", "<行|xing2>走", "<私|わたし>は", "a < b | c > d", "<|x|>", None]
    want = ["<|SPECIAL_TOKEN_1|>G OW1 . IH0 NG<|SPECIAL_TOKEN_1|> on", "<|SPECIAL_TOKEN_2|>XING2<|SPECIAL_TOKEN_2|>走", " わたし は", "a <|SPECIAL_TOKEN_1|> C <|SPECIAL_TOKEN_1|> d", "<|x|>", ""]
    assert one(spark, given, spans.annotated) == want
    issues = one(spark, ["<a|b> <c|> <|d> <e|f|g> <行|xing> <h|i", "<j|" + "k" * 41 + ">"], lambda c: F.transform(spans.annotation_issues(c), lambda s: s["issue"]))
    assert issues == [["no pronunciation", "no word", "several bars", "no tone", "not closed"], ["pronunciation too long"]]


def words(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def plain_split(text, count, budget, protected):
    """By the rules, one character at a time."""
    if count(text) <= budget:
        return [text]
    parts = []
    for piece, whole in packing.atoms(text, protected):
        for part in [piece] if whole else [p for p in re.split(f"(?<=[{packing.MARKS}])", piece) if p]:
            if whole or count(part) <= budget:
                parts.append(part)
                continue
            now = ""
            for ch in part:
                if now and count(now + ch) > budget:
                    parts.append(now)
                    now = ch
                else:
                    now += ch
            parts.append(now)
    out = []
    for part in parts:
        if out and count(out[-1] + part) <= budget:
            out[-1] += part
        else:
            out.append(part)
    return out


@pytest.mark.parametrize("count", [len, words, lambda t: (len(t.encode()) + 2) // 3])
def test_segments_are_those_of_the_plain_rule(count):
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(draw.choice(["ab", " ", ",", "。", "x-y-z", "é", "c"]) for _ in range(draw.randint(0, 60)))
        budget = draw.randint(1, 12)
        got = packing.split_by_tokens(text, count, budget, spans.TERM)
        assert "".join(got) == text and got == plain_split(text, count, budget, spans.TERM)
        assert all(count(s) <= budget or len(s) == 1 or re.fullmatch(spans.TERM, s) for s in got)


def test_segments_of_rows(spark):
    rows = spark.createDataFrame([(1, "a b c, d e"), (2, None), (3, "word " * 20_000)], "k int, t string")
    counter = lambda: lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    got = packing.token_segments(rows, ["k"], "t", counter, 3, prefix="say").collect()
    assert [(r.pos, r.segment, r.tokens) for r in sorted(got) if r.k == 1] == [(0, "a b ", 2), (1, "c,", 2), (2, " d e", 2)]
    assert [r.segment for r in got if r.k == 2] == [""] and "".join(r.segment for r in sorted(got) if r.k == 3) == "word " * 20_000


def test_one_bad_row_stops_no_other(spark):
    rows = spark.createDataFrame([(i, str(i) if i % 3 else "x") for i in range(20)] + [(20, None)], "i int, v string")
    got = {r.i: (r.value, r.error) for r in packing.mapped(rows, "v", lambda v: int(v) * 2, "int").collect()}
    assert len(got) == 21 and all(got[i] == (2 * i, None) for i in range(20) if i % 3)
    assert got[3][0] is None and got[3][1].startswith("ValueError") and got[20][1].startswith("TypeError")
    assert {r.error for r in packing.mapped(rows, "v", int, "int", stop_after=0.0).collect()} == {"stopped"}


def test_sql_functions(spark):
    sql.register(spark)
    got = spark.sql("SELECT speech_seconds(30) AS s, clamp(5, 0, 1) AS c, clamp(NULL, 0, 1) AS n, word_count('a  b\\nc') AS w, stable_seed(42, '7') AS k").first()
    assert (got.s, got.c, got.n, got.w) == (2.0, 1.0, None, 3) and 42 <= got.k < 100_042
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_lines('a\\n\\n b')").collect()] == [(0, "a"), (2, " b")]


def test_emotion_scores(spark):
    cases = [
        ('{"高兴": 2, "悲伤": -1}', "x", [1.2, 0, 0, 0, 0, 0, 0, 0]), ('{"label": " Sad "}', "x", [0, 0, 1, 0, 0, 0, 0, 0]), ('{"label": "sad", "高兴": 0.1}', "x", [0.1, 0, 0, 0, 0, 0, 0, 0]),
        ('{"高兴": "angry"}', "x", [0, 1, 0, 0, 0, 0, 0, 0]), ('"恐惧"', "x", [0, 0, 0, 1, 0, 0, 0, 0]), ("happy", "x", [1, 0, 0, 0, 0, 0, 0, 0]), ('高兴": 0.5, "高兴": .25', "x", [0.25, 0, 0, 0, 0, 0, 0, 0]),
        ('{"悲伤": 0.7}', "I feel GLOOMY", [0, 0, 0, 0, 0, 0.7, 0, 0]), ("[1]", "x", [0] * 7 + [1]), (None, None, [0] * 7 + [1]), ("", "x", [0] * 7 + [1]),
    ]
    df = spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(cases)], "i int, a string, s string")
    got = df.select("i", emotions.emotion_scores(F.col("a"), F.col("s")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [c[2] for c in cases]
