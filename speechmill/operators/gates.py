"""Rules that admit, clamp, label or score single rows, and small gates on groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Seconds within which an item can be trained on; the fewest samples; characters of a kept laugh.
TRAIN_SECONDS, LEAST_SAMPLES, LAUGH_CHARS = (1.0, 20.0), 20, (2, 30)
# Intensity, pause in ms and stressed words of a script line.
INTENSITY, PAUSE_MS, MOST_STRESSED = (0.05, 1.0), (0, 3000), 2
# Labels of an emotion model and the keys they stand for, in order of precedence.
MODEL_LABELS = {
    "生气/angry": "angry", "厌恶/disgusted": "disgusted", "恐惧/fearful": "afraid", "开心/happy": "happy", "中立/neutral": "calm", "难过/sad": "sad", "吃惊/surprised": "surprised",
    "其他/other": "", "<unk>": "", "angry": "angry", "disgusted": "disgusted", "fearful": "afraid", "happy": "happy", "neutral": "calm", "sad": "sad", "surprised": "surprised",
}
# A syllable of Pinyin with its tone, and an e-mail address.
PINYIN_TONE = r"((?:[bpmfdtnlgkhjqxzcsryw]|[zcs]h)?(?:[aeiouüv]|[ae]i|u[aio]|ao|ou|i[aue]|[uüv]e|[uvü]ang?|uai|[aeiuv]n|[aeio]ng|ia[no]|i[ao]ng)|ng|er)([1-5])"
EMAIL = r"^[a-zA-Z0-9]+@[a-zA-Z0-9]+\.[a-zA-Z]+$"
# Syllables a second, fastest and slowest, and the factor of Chinese.
SYLLABLES_PER_SECOND, CHINESE_FACTOR = (5.5, 3.0), 0.8517
HAN = "[一-鿿]"


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` between two bounds; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def transcribe_verdict(text: Column, seconds: Column) -> Column:
    """kept_existing if there is text, trainable if the length is unknown or fits, else untrainable."""
    d = F.coalesce(seconds, F.lit(0.0))
    return F.when(strip(text) != "", "kept_existing").when((d <= 0) | d.between(*TRAIN_SECONDS), "trainable").otherwise("untrainable")


def keeps_laugh(reason: Column, laughs: Column, normal: Column) -> Column:
    """A text that would go (``reason`` is not '') stays if a laugh was heard and its normal form is short."""
    return (reason != "") & laughs & F.char_length(normal).between(*LAUGH_CHARS)


def sample_gate(rows: DataFrame, by: list[str], least: int = LEAST_SAMPLES) -> DataFrame:
    """by, n, enough."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= least)


def whole_number(text: Column, low: int, high: int) -> Column:
    """A field of a state file: coerced and clamped; null, so dropped, if it is no whole number."""
    return clamp(text.try_cast("int"), low, high)


def clamped_line(emotion: Column, intensity: Column, pause: Column, stressed: Column, text: Column, emotions: tuple[str, ...]) -> list[Column]:
    """emotion, intensity, pause_ms, text, stressed of a script line, within their bounds.

    Null or 0 as intensity means 0.5; stressed words must occur in the text.
    """
    line = strip(text)
    said = F.filter(F.coalesce(stressed, F.array().cast("array<string>")), lambda w: (w != "") & line.contains(w))
    return [
        F.when(emotion.isin(*emotions), emotion).otherwise("calm").alias("emotion"),
        clamp(F.coalesce(F.nullif(intensity, F.lit(0.0)), F.lit(0.5)), *INTENSITY).alias("intensity"),
        clamp(F.coalesce(pause, F.lit(0)), *PAUSE_MS).cast("int").alias("pause_ms"), line.alias("text"), F.slice(said, 1, MOST_STRESSED).alias("stressed"),
    ]


def label_key(label: Column, names: dict[str, str] | None = None) -> Column:
    """The key of a label: of the same name, or of the first name that it begins with, or ''."""
    names = MODEL_LABELS if names is None else names
    clean = strip(label)
    out = None
    for name, key in names.items():
        out = F.when(clean == name, key) if out is None else out.when(clean == name, key)
    for name, key in names.items():
        out = out.when(clean.startswith(name), key)
    return out.otherwise("")


def speaks_chinese(text: Column) -> Column:
    """Chinese characters, no Latin letters, an e-mail address or Pinyin with tones."""
    return text.rlike(HAN) | ~text.rlike("[a-zA-Z]") | text.rlike(EMAIL) | text.rlike("(?iu)(?<![a-z])" + PINYIN_TONE)


def syllables(text: Column) -> Column:
    """Chinese characters and digits count one each, a Latin word its groups of vowels, at least one.

    Groups of vowels stand for a dictionary of English syllables, which is not at hand.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"))
    spoken = F.aggregate(words, F.lit(0), lambda n, w: n + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+"))))
    return F.regexp_count(text, F.lit("[一-鿿0-9]")) + spoken


def spoken_seconds(text: Column) -> list[Column]:
    """syllables, shortest and longest time in which a text is spoken."""
    n = syllables(text)
    factor = F.when(text.rlike("[一-鿿0-9]"), CHINESE_FACTOR).otherwise(1.0)
    fast, slow = SYLLABLES_PER_SECOND
    return [n.alias("syllables"), (n * factor / fast).alias("shortest"), (n * factor / slow).alias("longest")]


def language_id(lang: Column, known: tuple[str, ...], other: str = "common") -> Column:
    """The place of a language in ``known``; an unknown or null one counts as ``other``."""
    place = lambda v: F.array_position(F.array(*map(F.lit, known)), v)
    found = F.coalesce(place(F.lower(lang)), F.lit(0))
    return F.when(found > 0, found).otherwise(place(F.lit(other))).cast("int") - 1


def scaled_vector(vector: Column, alpha: float) -> Column:
    """Each number by ``alpha`` (0 to 1), cut after four decimals; as it is for 1."""
    a = max(0.0, min(1.0, alpha))
    if a == 1.0:
        return vector
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.transform(vector, lambda x: cut(x.cast("double") * a * 10000) / 10000)


def emotion_alpha(intensity: Column, alpha: float = 0.65, extrapolate: bool = False) -> Column:
    return clamp(F.lit(alpha) * (0.5 + clamp(intensity, 0.0, 1.0)), 0.0, 1.5 if extrapolate else 1.0)


def register_penalty(before: Column, now: Column, free: float = 3.0, most: float = 0.30) -> Column:
    """0.06 for each semitone beyond ``free`` between two pitches; 0 where one is unknown."""
    apart = F.abs(12 * F.log2(now / before))
    return F.when((before > 0) & (now > 0), F.least(F.lit(most), F.greatest(F.lit(0.0), apart - free) * 0.06)).otherwise(0.0)


def tail_penalty(level: Column) -> Column:
    """0.30 for a candidate whose last 50 ms are louder than -35 dB."""
    return F.when(level > -35.0, 0.30).otherwise(0.0)


def junction(pause_ms: Column, floor_ms: Column, tail: Column, head: Column) -> list[Column]:
    """gap_s, over_s, cut_tail_s, cut_head_s, bed_s and mode where two blocks meet.

    A script gap under 50 ms is raised to the floor, any to 30 ms. Silence there is beyond it is cut, half from each
    side, 20 ms of each kept; what is missing is filled.
    """
    script = F.greatest(F.coalesce(pause_ms, F.lit(0)), F.lit(0)) / 1000.0
    gap = F.greatest(F.when(script < 0.05, F.greatest(script, floor_ms / 1000.0)).otherwise(script), F.lit(0.03))
    over = tail + head - gap
    cut_tail = F.when(over > 0, F.least(over / 2, F.greatest(F.lit(0.0), tail - 0.02))).otherwise(0.0)
    cut_head = F.when(over > 0, F.least(over - cut_tail, F.greatest(F.lit(0.0), head - 0.02))).otherwise(0.0)
    bed = F.when(over > 0, 0.0).otherwise(-over)
    return [gap.alias("gap_s"), over.alias("over_s"), cut_tail.alias("cut_tail_s"), cut_head.alias("cut_head_s"), bed.alias("bed_s"), F.when(bed > 0, "bed").otherwise("crossfade").alias("mode")]


def near_onset(rows: DataFrame, group: str, step: str, onset: str, most: int) -> DataFrame:
    """``most`` checkpoints of each group from the one before the first at its onset or later; the last if none is."""
    order = Window.partitionBy(group).orderBy(step)
    placed = rows.withColumn("_k", F.row_number().over(order))
    at = placed.groupBy(group).agg(F.coalesce(F.min(F.when(F.col(step) >= F.col(onset), F.col("_k"))), F.max("_k")).alias("_at"))
    first = F.greatest(F.col("_at") - 1, F.lit(1))
    return placed.join(at, group).filter((F.col("_k") >= first) & (F.col("_k") < first + most)).drop("_k", "_at")


def composites(scores: DataFrame, by: str) -> DataFrame:
    """by, reward, tear, bursts (means over seeds) and composite, null without a reward."""
    means = scores.groupBy(by).agg(F.round(F.avg("reward"), 4).alias("reward"), F.round(F.avg("tear"), 2).alias("tear"), F.round(F.avg("bursts"), 2).alias("bursts"))
    return means.withColumn("composite", F.round(F.col("reward") - F.col("tear") / 100 - F.col("bursts") / 20, 4))


def margins(pairs: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """n, mean, least and most of the margins of preference pairs."""
    m = F.col(chosen) - F.col(rejected)
    return pairs.agg(F.count(m).alias("n"), F.avg(m).alias("mean"), F.min(m).alias("least"), F.max(m).alias("most"))


def against_first(rows: DataFrame, group: str, order: str, field: str) -> DataFrame:
    """Adds ``baseline``, the field of the group's first row (ties: the least field), and ``same``."""
    base = rows.groupBy(group).agg(F.min(F.struct(F.col(order).alias("o"), F.col(field).alias("f")))["f"].alias("baseline"))
    return rows.join(base, group).withColumn("same", F.col(field).eqNullSafe(F.col("baseline")))


def plan_by_folder(files: DataFrame, folder: Column, wanted: list[str], root: str) -> DataFrame:
    """Files of the wanted folders and of ``root``; all files if no wanted folder is there."""
    files = files.withColumn("_f", folder)
    chosen = files.filter(F.col("_f").isin(*wanted))
    return (files if chosen.isEmpty() else files.filter(F.col("_f").isin(*wanted, root))).drop("_f")


def import_shifted(new: DataFrame, known: DataFrame, uid: str, shifts: list[int]) -> DataFrame:
    """New rows whose uid is not known, each once as it is (shift 0) and once for each shift."""
    fresh = new.join(known.select(uid).distinct(), uid, "left_anti")
    return fresh.withColumn("shift", F.explode(F.array(*map(F.lit, [0, *shifts]))))


# What takes points from a reference recording, and the grades by the least score.
IDEAL = {"min_sec": 3.0, "ideal_min_sec": 8.0, "max_sec": 15.0, "min_sr": 16000, "ideal_sr": 22050, "min_snr_db": 15.0, "ideal_snr_db": 25.0, "max_clip_ratio": 0.001, "max_silence_ratio": 0.30}
GRADES = ((88, "优秀"), (72, "良好"), (55, "可用"), (38, "勉强"))
LOWEST_GRADE = "不建议使用"


def recording_score(seconds: Column, snr_db: Column, rate: Column, clipped: Column, level_db: Column, silent: Column, leading: Column, offset: Column) -> list[Column]:
    """score (0 to 100) and grade of a recording: 100 less the points of each fault."""
    faults = [
        F.when(seconds < IDEAL["min_sec"], 35).when(seconds < IDEAL["ideal_min_sec"], 15).when(seconds > IDEAL["max_sec"], 5),
        F.when(snr_db < IDEAL["min_snr_db"], 25).when(snr_db < IDEAL["ideal_snr_db"], 10),
        F.when(rate < IDEAL["min_sr"], 25).when(rate < IDEAL["ideal_sr"], 6),
        F.when(clipped > IDEAL["max_clip_ratio"], 20), F.when((level_db < -35) | (level_db > -6), 12), F.when(silent > IDEAL["max_silence_ratio"], 15),
        F.when(leading > 1.0, 10), F.when(F.abs(offset) > 0.01, 4),
    ]
    score = F.greatest(F.lit(0), F.lit(100) - sum((F.coalesce(f, F.lit(0)) for f in faults), F.lit(0)))
    grade = None
    for least, name in GRADES:
        grade = F.when(score >= least, name) if grade is None else grade.when(score >= least, name)
    return [score.cast("double").alias("score"), grade.otherwise(LOWEST_GRADE).alias("grade")]
