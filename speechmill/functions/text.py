"""Text functions on columns: comparison, cleaning, splitting, and verdicts on generated text."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import once

#: Full-width letters and digits and what they stand for.
FULL_WIDTH = "０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
HALF_WIDTH = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Marks that comparison ignores, and those that the verdict ignores (without the backslash and }).
COMPARE_MARKS = r"[\s　`~!@#$%^&*()_\-+=\[\]{}\\|;:'\",.<>/?·！？…。，、；：‘’“”（）《》〈〉【】〔〕％＃＠＆＊－＋＝｜｛｝／＼「」～￥]+"
VERDICT_MARKS = r"[\s　`~!@#$%^&*()_\-+=\[\]{|;:'\",.<>/?·！？…。，、；：‘’“”（）《》〈〉【】〔〕％＃＠＆＊－＋＝｜｛｝／＼「」～￥]+"


def _quick(marks: str) -> str:
    """The same characters as two classes, narrow ones (a bit set) first, wide ones as ranges behind a guard.

    A class of forty wide marks is asked one mark after the other for each letter that it doesn't hold.
    """
    held = re.sub(r"\\(.)", lambda m: " \t\n\x0b\f\r" if m[1] == "s" else m[1], marks[1:-2])
    codes = sorted({ord(c) for c in held})
    runs = [[c, c] for c in codes]
    for before, run in zip(runs, runs[1:], strict=False):
        if run[0] == before[1] + 1 and run[0] != 256:
            run[0] = before[0]
    whole = {start: end for start, end in runs}
    kind = lambda wide: "".join(rf"\x{{{start:x}}}-\x{{{end:x}}}" for start, end in sorted(whole.items()) if (start > 255) == wide)
    return rf"[{kind(False)}]++|[[^\x00-\x{{ff}}]&&[{kind(True)}]]++"


#: Sentences that recognisers invent over silence.
STOCK_PHRASES = (
    "请不吝点赞", "字幕由", "谢谢观看", "感谢观看", "请勿盗用", "有需要字幕", "明镜与点点", "字幕组", "小铃铛",
    "thanks for watching", "thank you for watching", "subscribe", "amara.org", "mbc news",
)
# A sentence with its closing marks, and what makes it one.
SENTENCE = r"[^。！？!?…；;\n]*[。！？!?…]+|[^。！？!?…；;\n]*[；;\n]+|[^。！？!?…；;\n]+"
#: The same in one pass, as what a run has taken it doesn't give back.
QUICK_SENTENCE = r"[^。！？!?…；;\n]*+(?:[。！？!?…]++|[；;\n]++)|[^。！？!?…；;\n]++"
WORDED = r"[\p{L}\p{N}_]"
#: White space in Unicode's sense, not only spaces.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that may repeat, that end a text, that are weaker, that a full stop may follow, that must not begin or end one.
RUN_MARKS, END_MARKS, WEAK_MARKS, TONE_MARKS, DOTS = "，。！？；、,.!?;:：", "。．.！!?？；;", "，,、", "!?？；;", "。．"
LAST_MARKS, LAST_MARKS_LATIN, OPEN_MARKS = "。！？?!…", "。！？?!….", "，,、；;：:"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; null as empty. One pass over each end."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def normalize_text(text: Column) -> Column:
    """Full-width letters and digits to ASCII, marks and spaces away, lower case; null as empty."""
    plain = F.coalesce(text, F.lit(""))
    narrow = F.when(plain.rlike("[０-９ａ-ｚＡ-Ｚ]"), F.translate(plain, FULL_WIDTH, HALF_WIDTH)).otherwise(plain)
    return F.lower(F.regexp_replace(narrow, _quick(COMPARE_MARKS), ""))


def error_rate(reference: Column, heard: Column) -> Column:
    """Edit distance of the normalized texts over the reference's length, at most 1; an empty reference allows nothing."""
    a, b = normalize_text(reference), normalize_text(heard)
    return F.when(a == b, 0.0).when(a == "", 1.0).otherwise(F.least(F.lit(1.0), F.levenshtein(a, b) / F.char_length(a)))


def sanitize_punctuation(text: Column, latin_terminal: bool = False) -> Column:
    """Runs of one mark to one, mixed pairs to their terminal mark, no marks in front, a terminal mark at the end.

    ``latin_terminal`` lets an ASCII full stop end a text; by default it gets an ideographic one behind it.
    """
    # Quantifiers are possessive and a match begins at the first of a run (or where the last match ended), so that no
    # run of white space or marks is tried from each of its characters.
    space = r"(?:\G|(?<!\s))\s*+"
    end = rf"(?:\G|(?<!\s)(?=\s)|(?<![\s{END_MARKS}])(?=[{END_MARKS}]))\s*+([{END_MARKS}]++)"
    t = strip(text)
    for pattern, by in (
        (rf"([{RUN_MARKS}])\1++", "$1"),
        (rf"{end}[{WEAK_MARKS}]\s*+", "$1"),
        (rf"{space}[{WEAK_MARKS}]\s*+([{END_MARKS}])", "$1"),
        (rf"([{TONE_MARKS}])[{DOTS}]", "$1"),
        (rf"^[\s{RUN_MARKS}]++", ""),
    ):
        t = F.regexp_replace(t, pattern, by)
    t = F.rtrim(t, F.lit(SPACES))
    ends = f"[{LAST_MARKS_LATIN if latin_terminal else LAST_MARKS}]$"
    return F.when(t == "", "").when(t.rlike(f"[{OPEN_MARKS}]$"), F.concat(F.substring(t, F.lit(1), F.char_length(t) - 1), F.lit("。"))).when(t.rlike(ends), t).otherwise(F.concat(t, F.lit("。")))


def sentences(text: Column) -> Column:
    """Sentences with their closing marks and without outer white space; those without a letter or digit are dropped."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUICK_SENTENCE), F.lit(0)), strip)
    return F.filter(found, lambda s: s.rlike(WORDED))


def split_after_marks(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[，。！？、；：,.!?;:\n])"), lambda s: s != "")


def pack_greedily(parts: Column, limit: int) -> Column:
    """Neighbouring parts joined while they hold at most ``limit`` characters; a longer part stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.char_length(acc["now"]) + F.char_length(part) <= limit
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["now"], part).alias("now"))).otherwise(
            F.struct(F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), part.alias("now"))
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def verdict_core(text: Column) -> Column:
    return F.regexp_replace(strip(text), _quick(VERDICT_MARKS), "")


def _counted(core: str | None) -> list[int] | None:
    if core is None:
        return None
    counts = Counter(core)
    return [len(core), len(counts), max(counts.values(), default=0)]


def character_counts(core: Column) -> Column:
    """Characters of a text, different ones, and how often the most frequent one occurs."""
    return F.udf(_counted, T.ArrayType(T.IntegerType()), useArrow=True)(core)


def with_degenerate_reason(rows: DataFrame, text: str, name: str, min_chars: int = 2, strict_repeat: bool = False) -> DataFrame:
    """Adds ``name``: why a generated text is useless, '' if it isn't.

    Characters are counted once for each row. The rule against six equal characters in a row is off by default, as the
    text it comes from never applied it.
    """
    body = F.col(f"`{text}`")
    step = rows.withColumn("_core", verdict_core(body)).withColumn("_counts", character_counts(F.col("_core")))
    core, size, kinds, most = F.col("_core"), F.get("_counts", F.lit(0)), F.get("_counts", F.lit(1)), F.get("_counts", F.lit(2))

    def stocked(low: Column) -> Column:
        found = F.lit(False)
        for phrase in STOCK_PHRASES:
            found = found | low.contains(phrase)
        return found

    stock = once(F.lower(body), stocked)
    out = F.when(strip(body) == "", "empty").when(size < min_chars, "too_short").when(kinds == 1, "single_character").when(most / size >= 0.5, "one_character_dominates")
    if strict_repeat:
        out = out.when(core.rlike(r"(.)\1{5,}"), "repeated_character")
    out = out.when((size >= 8) & (kinds / size < 0.15), "few_characters").when(stock, "stock_phrase").otherwise("")
    return step.withColumn(name, out).drop("_core", "_counts")


def rich_transcript(raw: Column, events: tuple[str, ...], emotions: dict[str, str]) -> Column:
    """struct(text, emotion, events) of a transcript with <|tags|>; the first emotion in the mapping's order counts.

    The text is sanitised as texts to train on are.
    """
    names = "|".join(events)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit(rf"<\|({names})\|>"), F.lit(1))))
    mood = F.coalesce(*[F.when(raw.contains(f"<|{tag}|>"), F.lit(key)) for tag, key in emotions.items()], F.lit(""))
    text = sanitize_punctuation(F.regexp_replace(F.regexp_replace(raw, r"<\|[^|]*\|>", ""), r"\s+", " "))
    return F.struct(text.alias("text"), mood.alias("emotion"), found.alias("events"))


def cjk_tokens(text: Column) -> Column:
    """Each CJK character a token of its own, other runs as words, upper case."""
    spaced = F.regexp_replace(F.trim(F.upper(text)), r"([\x{1100}-\x{11FF}\x{2E80}-\x{A4CF}\x{A840}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF65}-\x{FFDC}\x{20000}-\x{2FFFF}])", " $1 ")
    return F.filter(F.split(F.trim(spaced), r"\s+"), lambda w: w != "")


def correct_pinyin(text: Column) -> Column:
    """After j, q and x a written u is ü, spelt v; upper case."""
    return F.upper(F.regexp_replace(text, r"(?i)^([jqx])u(?=[a-z]*\d?$)", "$1v"))


def safe_name(name: Column) -> Column:
    """A name that a folder may have."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'[\\/:*?"<>|\s]+', "_"), r"^[._]+|[._]+$", "")


def replace_terms(text: Column, terms: dict[str, str]) -> Column:
    """Literal, case-insensitive replacement, longer terms first."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        text = F.regexp_replace(text, f"(?i){quoted}", terms[term].replace("\\", "\\\\").replace("$", "\\$"))
    return text
