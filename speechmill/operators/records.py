"""Operators on tables of records: updates, sets, ids, catalogs and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import ready_for_checkpoints

#: Lengths in seconds and loudness above noise that a recording must have.
MIN_SECONDS, TRAIN_SECONDS, HARD_SECONDS, MIN_SNR = 1.0, 20.0, 72.6, 15.0

#: A list of more names is a table, not a parameter.
MOST_NAMES = 10_000


def update_fields(records: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Non-null fields of ``changes`` replace those of known records; nothing is inserted, unknown fields are ignored.

    Of several changes of one field the last by ``order`` counts, or without one the least value; a change that leaves a
    field null leaves the others' value of it alone.
    """
    fields = [c for c in changes.columns if c in records.columns and c not in (key, order)]
    pick = lambda c: F.min(c) if order is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c)))
    new = changes.groupBy(key).agg(*[pick(c).alias(f"_new_{c}") for c in fields])
    joined = records.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in records.columns])


def by_id(records: DataFrame, key: str, value) -> DataFrame:
    """The rows of one id; a filter that reaches the files, so that most of them aren't read."""
    return records.filter(F.col(key) == F.lit(value))


def only_new(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in ``order`` for each key that ``existing`` doesn't have."""
    first = Window.partitionBy(*keys).orderBy(*order)
    once = incoming.withColumn("_at", F.row_number().over(first)).filter("_at = 1").drop("_at")
    return once.join(existing.select(*keys).distinct(), keys, "left_anti")


def next_ids(incoming: DataFrame, existing: DataFrame, column: str, order: list[str], prefix: str = "utt_", parts: int = 16) -> DataFrame:
    """Ids that go on from the highest number in use; numbered in parts by order, so no task sorts all rows.

    Parts come from sampled bounds, which differ from one execution to the next, so the parts are checkpointed before
    they are counted and numbered.
    """
    ready_for_checkpoints(incoming.sparkSession)
    top = existing.agg(F.coalesce(F.max(F.regexp_extract(column, r"(\d+)$", 1).try_cast("long")), F.lit(0))).first()[0]
    dealt = incoming.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    offsets = counts.select("_part", (F.lit(top) + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_offset"))
    number = F.col("_offset") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(column, F.format_string(f"{prefix}%05d", number)).drop("_part", "_offset")


def status(text: Column, seconds: Column, snr: Column, has_features: Column, need_features: bool = False, has_audio: Column | None = None) -> tuple[Column, Column]:
    """The first problem that counts, or ready; and all problems. Without audio (file or length) that is the only one."""
    empty = strip(text) == ""
    missing = ~has_features if need_features else F.lit(False)
    tests = [("no_text", empty), ("over_hard_limit", seconds > HARD_SECONDS), ("too_long", seconds.between(TRAIN_SECONDS, HARD_SECONDS) & (seconds > TRAIN_SECONDS)), ("too_short", seconds < MIN_SECONDS), ("low_snr", snr < MIN_SNR), ("no_features", missing)]
    verdict = F.when(tests[0][1], tests[0][0])
    for name, test in tests[1:]:
        verdict = verdict.when(test, name)
    verdict, problems = verdict.otherwise("ready"), F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    if has_audio is None:
        return verdict, problems
    gone = ~F.coalesce(has_audio, F.lit(False)) | F.coalesce(seconds < 0, F.lit(True))
    return F.when(gone, "missing_audio").otherwise(verdict), F.when(gone, F.array(F.lit("missing_audio"))).otherwise(problems)


#: Parts that the rows of one key are ranked in before their best meet.
PARTS = 64


def _over(rows: DataFrame, key: list[str], order: list[str], most: int, counts: Column, name: str, parts: int = PARTS) -> DataFrame:
    """Adds ``name``: whether a row that ``counts`` is beyond the first ``most`` of its key.

    Rows of a key are first ranked in parts; only the first ``most`` of each part meet, so that no task ranks all rows of
    a key that a third of them share. Rows that don't count are never brought together.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    rows = rows.withColumns({"_counts": F.coalesce(counts, F.lit(False)), "_part": part})
    local = Window.partitionBy(*key, "_counts", "_part").orderBy(*order)
    rows = rows.withColumn("_first", F.col("_counts") & (F.row_number().over(local) <= most))
    rows = rows.withColumn("_part", F.when(F.col("_first"), -1).otherwise(F.col("_part")))
    whole = Window.partitionBy(*key, "_first", "_part").orderBy(*order)
    over = F.col("_counts") & (~F.col("_first") | (F.row_number().over(whole) > most))
    return rows.withColumn(name, over).drop("_counts", "_part", "_first")


def keep_repeats(records: DataFrame, key: Column, order: list[str], most: int) -> DataFrame:
    """Marks in ``over`` the rows beyond the first ``most`` with the same key; keys are told apart by 128 bits."""
    return _over(records.withColumn("_key", F.md5(key.cast("string").cast("binary"))), ["_key"], order, most, F.lit(True), "over").drop("_key")


def curate(records: DataFrame, reason: Column, score: Column, min_score: float, key: Column, order: list[str], most: int) -> DataFrame:
    """Adds ``drop_reason``: text, score, or too many repeats among the rows that pass the other tests; '' for kept rows."""
    first = records.withColumn("drop_reason", F.when(reason != "", F.concat(F.lit("text: "), reason)).when(score < min_score, "score too low").otherwise(""))
    keyed = first.withColumn("_key", F.md5(key.cast("string").cast("binary")))
    marked = _over(keyed, ["_key"], order, most, F.col("drop_reason") == "", "_over")
    return marked.withColumn("drop_reason", F.when(F.col("_over"), "repeats over the limit").otherwise(F.col("drop_reason"))).drop("_key", "_over")


def contained_name(rows: DataFrame, text: str, names: list[str], limit: int = MOST_NAMES) -> DataFrame:
    """Adds ``match``: the first of a short list of names that the text contains. The list is part of the plan."""
    if len(names) > limit:
        raise ValueError(f"{len(names)} names; a list of over {limit} is a table, not a parameter")
    return rows.withColumn("match", F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.col(text), n)), F.lit(0)))


def pick_with_fallback(asked: DataFrame, bank: DataFrame, group: str, kind: str, score: list[str], calm: str, columns: list[str]) -> DataFrame:
    """For each asked (group, kind) the best exact entry, else, unless the kind is calm, the best of the same group."""
    best = F.max_by(F.struct(*columns), F.struct(*score))
    exact = bank.groupBy(group, kind).agg(best.alias("_exact"))
    any_ = bank.groupBy(group).agg(best.alias("_any"))
    joined = asked.join(exact, [group, kind], "left").join(any_, group, "left")
    chosen = F.coalesce("_exact", F.when(F.col(kind) != calm, F.col("_any")))
    return joined.withColumn("_c", chosen).select(*asked.columns, *[F.col(f"_c.{c}").alias(c) for c in columns])
