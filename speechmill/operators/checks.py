"""Checks that give issues as rows, and sung transcripts as texts and intervals of technique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import merge_adjacent

# Sizes of features, the most codes, frames for each code, the share they may be off, pitch and technique.
MEL_BANDS, MU_WIDTH, STYLE_WIDTH, EMOTION_WIDTH, MOST_CODES, FRAMES_PER_CODE, OFF, MOST_HZ, TECHNIQUES = 80, 512, 192, 1280, 1815, 3.44, 0.05, 1600.0, 6
# Flags of a sung word and the number of their technique, in order of precedence; marks that set one.
FLAGS = {"mix": 1, "falsetto": 2, "breathy": 3, "pharyngeal": 4, "glissando": 6, "vibrato": 5}
SET_MARKS = ("1", "1.0", "true")
#: Words of characters below this are Latin and stand between spaces.
CJK_FROM = 0x2E80


def _found(tests: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]))


def feature_issues(c: dict[str, Column]) -> Column:
    """array<string> of broken invariants of a feature file, from its sizes; what a row lacks (null) isn't tested.

    c: mel_len, mel_bands, mel_frames, mu_prompt_frames, mu_prompt_width, mu_target_frames, mu_target_width, style_width,
    emotion_width, n_codes, n_text_tokens; and if there is singing, f0_frames, f0_max, technique_frames, technique_min, technique_max.
    """
    none = F.lit(None)
    v = {k: c.get(k, none) for k in ("f0_frames", "f0_max", "technique_frames", "technique_min", "technique_max")} | c
    length, expected = v["mel_len"], v["n_codes"] * FRAMES_PER_CODE
    return _found({
        "mel_shape": (v["mel_bands"] != MEL_BANDS) | (v["mel_frames"] != length),
        "mu_prompt_frames": v["mu_prompt_frames"] != length, "mu_prompt_width": v["mu_prompt_width"] != MU_WIDTH, "mu_target_frames": v["mu_target_frames"] != length, "mu_target_width": v["mu_target_width"] != MU_WIDTH,
        "style_width": v["style_width"] != STYLE_WIDTH, "emotion_width": v["emotion_width"] != EMOTION_WIDTH,
        "frame_ratio": (v["n_codes"] > 0) & (F.abs(expected - length) / F.greatest(F.lit(1.0), expected) > OFF), "few_text_tokens": v["n_text_tokens"] < 2, "many_codes": v["n_codes"] > MOST_CODES,
        "mu_shapes_differ": (v["mu_prompt_frames"] != v["mu_target_frames"]) | (v["mu_prompt_width"] != v["mu_target_width"]),
        "f0_frames": v["f0_frames"] != length, "f0_range": v["f0_max"] > MOST_HZ, "technique_frames": v["technique_frames"] != length, "technique_range": (v["technique_max"] > TECHNIQUES) | (v["technique_min"] < 0),
    })


def option_notices(engine: Column, size: Column, sizes: dict[str, int], wer: Column, sim: Column, other_weights: list[Column], beam: Column, language: Column, languages: tuple[str, ...], large: int = 700) -> Column:
    """array<struct<level, name>> of what scoring options call for: error, warn or info. sizes: models and their millions of weights."""
    told = [
        ("error", "unknown_size", ~size.isin(*sizes)), ("error", "unknown_engine", ~engine.isin("whisper", "sensevoice")),
        *[("error", f"negative_weight_{i}", w < 0) for i, w in enumerate(other_weights)], ("info", "engine_falls_back", engine == "sensevoice"), ("warn", "large_model", size.isin(*[k for k, n in sizes.items() if n >= large])),
        ("error", "weights", (wer < 0) | (sim < 0) | (wer + sim <= 0)), ("info", "weights_sum", (wer >= 0) & (sim >= 0) & (wer + sim > 0) & (F.abs(wer + sim - 1) > 1e-6)),
        ("error", "unknown_language", (language != "") & ~language.isin(*languages)), ("error", "beam", ~beam.between(1, 10)),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"))) for level, name, t in told]))


_WORDS = "array<struct<word:string,start_time:double,end_time:double," + ",".join(f"{f}:array<string>" for f in FLAGS) + ">>"


def sung_words(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key and words (in order of start) of transcripts: JSON arrays of words with times and flags; empty for any other JSON."""
    words = F.coalesce(F.from_json(json, _WORDS), F.array().cast(_WORDS))
    words = F.filter(words, lambda w: w.isNotNull())
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(F.coalesce(w["start_time"], F.lit(0.0)).alias("s"), i.alias("i"), w.alias("w"))))
    return rows.select(key, F.transform(placed, lambda p: p["w"]).alias("words"))


def sung_text(words: Column) -> Column:
    """CJK words side by side, Latin ones between spaces."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("latin"))

    def add(now: Column, w: Column) -> Column:
        word = F.coalesce(w["word"], F.lit(""))
        latin = ~word.rlike(f"[^\\x{{0}}-\\x{{{CJK_FROM - 1:X}}}]")
        space = F.when((now["text"] != "") & (latin | now["latin"]), " ").otherwise("")
        return F.when(word == "", now).otherwise(F.struct(F.concat(now["text"], space, word).alias("text"), latin.alias("latin")))

    return F.aggregate(words, start, add, lambda s: s["text"])


def technique_intervals(words: DataFrame, key: str, gap: float = 0.02) -> DataFrame:
    """key, start, end, technique of words that have one; neighbours of one technique that touch are one interval."""
    w = words.select(key, F.explode("words").alias("w"))
    technique = F.coalesce(*[F.when(F.exists(F.col(f"w.{flag}"), lambda m: m.isin(*SET_MARKS)), F.lit(n)) for flag, n in FLAGS.items()])
    start = F.coalesce("w.start_time", F.lit(0.0))
    rows = w.select(key, technique.alias("technique"), start.alias("start"), F.coalesce("w.end_time", start).alias("end")).filter("technique is not null and end > start")
    joined = merge_adjacent(rows, key, "start", "end", "technique", gap, touching=True)
    return joined.select(key, F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "technique")
