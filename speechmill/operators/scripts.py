"""Scripts by rule: sentences with emotion, stressed words and pauses, and their merge to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import once
from ..functions.text import SPACES, sentences

# Emotion keys in order of precedence, words that speak for them, stressed words.
EMOTIONS = ("happy", "angry", "sad", "afraid", "disgusted", "melancholic", "surprised", "calm")
EMOTION_WORDS = {
    "angry": ("可恶", "气死", "住手", "该死", "滚", "混蛋", "不可原谅", "敢", "休想", "找死", "岂有此理", "放肆", "战", "杀"),
    "happy": ("哈哈", "太好了", "万岁", "好棒", "开心", "高兴", "终于", "成功", "赢了", "谢谢", "喜欢", "可爱", "嘿嘿", "呵呵"),
    "sad": ("对不起", "抱歉", "再见", "永别", "眼泪", "哭泣", "悲伤", "难过", "为什么", "舍不得", "失去", "再也", "怀念", "孤独"),
    "afraid": ("不要", "救命", "害怕", "怪物", "危险", "快跑", "救命啊", "恐怖", "吓", "颤抖", "黑暗"),
    "disgusted": ("恶心", "讨厌", "肮脏", "虚伪", "卑鄙", "无耻", "渣滓", "呕"),
    "melancholic": ("也许", "大概", "算了", "罢了", "无奈", "叹息", "孤独", "沉默", "回忆", "曾经", "注定"),
    "surprised": ("什么", "怎么会", "竟然", "居然", "难道", "原来", "啊？", "真的假的", "意想不到"),
}
STRESS_WORDS = ("不", "没", "别", "很", "太", "最", "更", "必须", "一定", "绝对", "永远", "都", "也", "才", "就", "竟", "居然")
# Pause in ms by a mark in the last three characters, in this order; factor by emotion; band by final mark.
PAUSES = (("…", 600), ("—", 380), ("！!", 300), ("？?", 280), ("。.", 240), ("；;", 240), ("：:", 230), ("，,", 140), ("、", 120))
PAUSE_FACTORS = {"sad": 1.20, "melancholic": 1.20, "afraid": 1.05, "angry": 0.90, "happy": 0.90, "surprised": 0.95, "disgusted": 1.00, "calm": 1.00}
BANDS = (("……", 580, 820), ("——", 480, 640), ("！", 260, 380), ("？", 250, 370), ("。", 320, 450), ("；", 200, 300), ("：", 200, 300), ("，", 120, 210), ("、", 100, 170))
OTHER_BAND, COMMA_BAND = (320, 450), (120, 210)
FINAL_MARKS = "…—！？。.；;：:，,、!?"
#: Marks after which a block takes another line without a full stop between.
CLOSED = "。！？…！？.!?\""


def guessed_emotion(line: Column) -> Column:
    """struct(emotion, intensity): most words found (ties: first key), then what !, ? and … add. Words are looked for once a line, in lines that have such characters."""
    hits = [sum((line.contains(w).cast("int") for w in ws), F.lit(0)) for ws in EMOTION_WORDS.values()]
    found = F.when(line.rlike("[一-鿿]"), F.array(*hits)).otherwise(F.array(*[F.lit(0)] * len(hits)))
    seen = F.struct(found.alias("hits"), F.array_max(found).alias("best"), line.rlike("[！!]").alias("shout"), line.rlike("[？?]").alias("ask"), line.contains("…").alias("trail"))
    places = list(EMOTION_WORDS)

    def guess(s: Column) -> Column:
        best, shout, ask, trail = s["best"], s["shout"], s["ask"], s["trail"]
        key = F.when(best == 0, "calm")
        for e in EMOTIONS:
            if e in EMOTION_WORDS:
                key = key.when(F.get(s["hits"], F.lit(places.index(e))) == best, e)
        strength = F.when(best == 0, 0.35).otherwise(F.least(F.lit(0.9), 0.5 + 0.15 * best))
        strength = F.when(shout, F.least(F.lit(0.95), strength + 0.15)).otherwise(strength)

        def told(key: Column) -> Column:
            calm = key == "calm"
            emotion = F.when(calm & shout, "happy").when(calm & ask, "surprised").when(calm & trail, "melancholic").otherwise(key)
            moved = F.when(calm & ~shout & ask, F.greatest(strength, F.lit(0.5))).when(calm & ~shout & ~ask & trail, 0.45).otherwise(strength)
            return F.struct(emotion.alias("emotion"), F.round(moved, 2).alias("intensity"))

        return once(key, told)

    return once(seen, guess)


def guess_emotion(line: Column) -> tuple[Column, Column]:
    """Emotion key and intensity, as two columns."""
    both = guessed_emotion(line)
    return both["emotion"], both["intensity"]


def stressed_words(line: Column) -> Column:
    """The first two listed words by place, in lines of four characters or more."""
    places = F.array_compact(F.array(*[F.when(line.contains(w), F.struct(F.instr(line, w).alias("at"), F.lit(i).alias("i"), F.lit(w).alias("w"))) for i, w in enumerate(STRESS_WORDS)]))
    found = F.transform(F.slice(F.array_sort(places), 1, 2), lambda p: p["w"])
    return F.when(F.char_length(line) >= 4, found).otherwise(F.array().cast("array<string>"))


def _band(line: Column) -> tuple[Column, Column]:
    out = [None, None]
    for mark, *band in BANDS:
        for k in (0, 1):
            hit = line.endswith(mark)
            out[k] = F.when(hit, band[k]) if out[k] is None else out[k].when(hit, band[k])
    return out[0].otherwise(OTHER_BAND[0]), out[1].otherwise(OTHER_BAND[1])


def pause_after(line: Column, emotion: Column, jitter: Column, scale: float = 1.0) -> Column:
    """Pause in ms: by mark, emotion and ``jitter`` (0.85 to 1.15), held in the band of the final mark."""
    base = None
    tail = F.substring(line, -3, 3)
    for marks, ms in PAUSES:
        hit = tail.rlike(f"[{marks}]")
        base = F.when(hit, ms) if base is None else base.when(hit, ms)
    factor = F.coalesce(*[F.when(emotion == e, f) for e, f in PAUSE_FACTORS.items()], F.lit(1.0))
    lo, hi = _band(line)
    ms = base.otherwise(240) * factor * jitter
    return F.floor(F.greatest(F.greatest(F.lit(80.0), lo * scale), F.least(F.least(F.lit(2000.0), hi * scale), ms))).cast("int")


def least_pause(line: Column, scale: float = 1.0) -> Column:
    """The least pause in ms between blocks: 0 without a final mark, else above what a comma inside a block may have."""
    t = F.rtrim(F.coalesce(line, F.lit("")), F.lit(SPACES))
    lo, _ = _band(t)
    comma = int(min(2000, COMMA_BAND[1] * scale)) + 50
    return F.when(F.substring(t, -1, 1).isin(*FINAL_MARKS), F.greatest(F.greatest(F.lit(80), F.floor(lo * scale).cast("int")), F.lit(comma))).otherwise(0)


def hashed_jitter(*key: Column) -> Column:
    """0.85 to 1.15, the same for the same key."""
    part = F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 7), 16, 10).cast("double") / float(16**7)
    return 0.85 + 0.30 * part


def rules_script(texts: DataFrame, key: str, text: str, seed: int = 0, scale: float = 1.0) -> DataFrame:
    """``key``, pos, line, emotion, intensity, pause, stress: a script line for each sentence."""
    # The outer explode splits once; an inner one would be asked for its size before, by splitting twice more.
    lines = texts.select(key, F.posexplode_outer(sentences(F.col(text))).alias("pos", "line")).filter("pos is not null")
    lines = lines.select("*", guessed_emotion(F.col("line")).alias("_e")).select(key, "pos", "line", F.col("_e.emotion").alias("emotion"), F.col("_e.intensity").alias("intensity"))
    jitter = hashed_jitter(F.lit(str(seed)), F.col(key).cast("string"), F.col("pos").cast("string"))
    return lines.select("*", pause_after(F.col("line"), F.col("emotion"), jitter, scale).alias("pause"), stressed_words(F.col("line")).alias("stress"))


def merge_blocks(lines: DataFrame, key: str, order: str, most_tokens: int = 120, most_chars: int = 40) -> DataFrame:
    """``key``, first, n, tokens, chars: blocks of neighbouring lines (line, emotion, tokens) of one emotion.

    A block takes a line while its tokens and its characters, with one for a joint, stay within the limits, and closes
    behind … or —. Windows cut a script where blocks must end anyway, so that only what lies between is folded.
    """
    sequence = Window.partitionBy(key).orderBy(order)
    cut = (F.lag("emotion").over(sequence) != F.col("emotion")) | F.lag("line").over(sequence).rlike("[…—]$")
    rows = lines.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int")).withColumn("_run", F.sum("_cut").over(sequence.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(F.col(order).cast("bigint").alias("pos"), F.col("tokens").cast("bigint").alias("tokens"), F.char_length("line").cast("bigint").alias("chars"), F.substring("line", -1, 1).isin(*CLOSED).alias("closed"))
    runs = rows.groupBy(key, "_run").agg(F.array_sort(F.collect_list(item)).alias("s"))
    none = F.array().cast("array<struct<first:bigint,n:bigint,tokens:bigint,chars:bigint,closed:boolean>>")

    def feed(acc: Column, x: Column) -> Column:
        now = F.try_element_at(acc, F.lit(-1))
        fits = (now["tokens"] + x["tokens"] <= most_tokens) & (now["chars"] + x["chars"] + 1 <= most_chars)
        joint = F.when(now["closed"], F.lit(0)).otherwise(1).cast("bigint")
        grown = F.struct(now["first"].alias("first"), (now["n"] + 1).alias("n"), (now["tokens"] + x["tokens"]).alias("tokens"), (now["chars"] + x["chars"] + joint).alias("chars"), x["closed"].alias("closed"))
        fresh = F.struct(x["pos"].alias("first"), F.lit(1).cast("bigint").alias("n"), x["tokens"].alias("tokens"), x["chars"].alias("chars"), x["closed"].alias("closed"))
        return F.when(F.coalesce(fits, F.lit(False)), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(F.array_append(acc, fresh))

    blocks = runs.select(key, F.explode(F.aggregate("s", none, feed)).alias("b"))
    return blocks.select(key, "b.first", "b.n", "b.tokens", "b.chars")
