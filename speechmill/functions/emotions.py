"""Emotion scores from what a text model answers: JSON, labels, or something near JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The model's names of emotions in the vector's order and what they stand for; names under which it may
# give one label; words of a text that make sadness low spirits; the range of a score; a pair in an answer that isn't JSON.
NAMES = {"高兴": "happy", "愤怒": "angry", "悲伤": "sad", "恐惧": "afraid", "反感": "disgusted", "低落": "melancholic", "惊讶": "surprised", "自然": "calm"}
ALIASES = ("emotion", "emotion_label", "label", "情感", "情绪")
LOW_WORDS = ("低落", "melancholy", "melancholic", "depression", "depressed", "gloomy")
LEAST, MOST = 0.0, 1.2
PAIR = r'([^\s":.,]+)"?\s*:\s*([\d.]+)'


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def emotion_scores(answer: Column, said: Column) -> Column:
    """array<double> in the order of ``NAMES``: each from 0 to 1.2, missing ones 0, and calm 1 if nothing is above 0.

    A label alone, under an alias or as a score's value, counts 1. A text with one of ``LOW_WORDS`` has sadness and low
    spirits changed for each other. A null answer is calm.
    """
    names = F.array(*map(F.lit, NAMES))
    known = F.create_map(*[F.lit(x) for name, english in NAMES.items() for pair in ((name, name), (english, name)) for x in pair])
    label = lambda v: F.try_element_at(known, F.lower(F.trim(v)))
    low = F.coalesce(F.greatest(*[F.contains(F.lower(said), F.lit(w)) for w in LOW_WORDS]), F.lit(False))
    asked = F.when(low, F.array(*[F.lit({"悲伤": "低落", "低落": "悲伤"}.get(n, n)) for n in NAMES])).otherwise(names)
    pair = lambda k: F.regexp_extract_all(answer, F.lit(PAIR), F.lit(k))
    read = F.struct(F.from_json(answer, "map<string,string>").alias("m"), pair(1).alias("k"), pair(2).alias("v"))

    def value(r: Column, name: Column) -> Column:
        last = F.size(r["k"]) - F.array_position(F.reverse(r["k"]), name)
        return F.when(r["m"].isNotNull(), F.try_element_at(r["m"], name)).when(F.array_contains(r["k"], name), F.get(r["v"], last.cast("int")))

    def found(r: Column) -> Column:
        one = F.coalesce(label(F.regexp_replace(answer, '^\\s*"|"\\s*$', "")), *[label(F.try_element_at(r["m"], F.lit(a))) for a in ALIASES])
        return F.struct(F.transform(asked, lambda n: value(r, n)).alias("values"), one.alias("one"))

    def scored(f: Column) -> Column:
        some, labels = F.exists(f["values"], lambda v: v.isNotNull()), F.transform(f["values"], label)

        def score(v: Column, i: Column) -> Column:
            name = F.get(names, i)
            told = (~some & (f["one"] == name)) | F.exists(labels, lambda x: x == name)
            return F.when(F.coalesce(told, F.lit(False)), 1.0).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(v.try_cast("double"), F.lit(0.0)))))

        return F.transform(f["values"], score)

    calm = list(NAMES).index("自然")
    scores = _bound(_bound(read, found), scored)
    return _bound(scores, lambda s: F.transform(s, lambda x, i: F.when((i == calm) & ~F.exists(s, lambda y: y > 0), 1.0).otherwise(x)))
