"""Samples, pairs and plans for training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def import_verdicts(pairs: DataFrame, existing: DataFrame, key: list[str], margin: str, least: float, order: list[str]) -> DataFrame:
    """Adds ``verdict`` to sidecar pairs: missing (a part of the key is null), margin (too small), duplicate, or imported."""
    missing = F.greatest(*[F.col(k).isNull() for k in key])
    known = existing.select(*key).distinct().withColumn("_known", F.lit(True))
    rows = pairs.join(known, key, "left")
    good = ~missing & (F.col(margin) >= least)
    # Of good pairs with one key the first in order counts; the least row is joined, so that a hot key is no window.
    first = rows.filter(good & F.col("_known").isNull()).groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    rows = rows.join(first, key, "left")
    later = F.coalesce(F.struct(*order) != F.col("_first"), F.lit(True))
    verdict = F.when(missing, "missing").when(F.col(margin) < least, "margin").when(F.col("_known").isNotNull() | later, "duplicate").otherwise("imported")
    return rows.withColumn("verdict", verdict).drop("_known", "_first")


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All existing rows, and the incoming ones whose key isn't there yet; these aren't compared with each other."""
    return existing.unionByName(incoming.join(existing.select(key).distinct(), key, "left_anti"))


def shortest(rows: DataFrame, text: str, seconds: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows with the shortest trimmed text, then the least duration."""
    return rows.orderBy(F.char_length(strip(text)), F.asc_nulls_last(seconds), tie).limit(n)


def usable(rows: DataFrame, codes: str, chars: str, most_codes: int, most_chars: int) -> DataFrame:
    """Adds ``kept``: at least two codes and one character, at most the limits."""
    return rows.withColumn("kept", F.col(codes).between(2, most_codes) & F.col(chars).between(1, most_chars))


#: Rows that one task may put in order.
ORDERED_ROWS = 100_000


def least_hashes(rows: DataFrame, hashed: str, tie: str, n: int, ordered: int = ORDERED_ROWS) -> DataFrame:
    """The ``n`` rows of the least (``hashed``, ``tie``); ``hashed`` is a column of hexadecimal digits.

    Counts by the next four digits tell which rows are below the cut for sure; only the stretch that the cut falls
    into, of at most ``ordered`` rows, is put in order.
    """
    start, left = "", n
    while True:
        inside = rows.filter(F.col(hashed).startswith(start)) if start else rows
        digits = F.substring(hashed, len(start) + 1, 4)
        counts = sorted((r.d, r.n) for r in inside.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())  # 65,536 rows at most
        for digit, count in counts:
            if count > left:
                break
            left -= count
        else:
            return rows  # there are no more than n
        start += digit
        if count <= ordered or len(digit) < 4:
            taken = rows.filter(F.col(hashed).startswith(start)).orderBy(hashed, tie).limit(left)
            return rows.filter((F.col(hashed) < start) & ~F.col(hashed).startswith(start)).unionByName(taken)


def epoch_mix(target: DataFrame, pool: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """kind, key, copies: all target rows, and of the pool what makes up ``ratio`` of the whole.

    That number is n * ratio / (1 - ratio), halves to even. A pool that is large enough is drawn from without
    replacement, by least hashes. One that is too small is drawn evenly: each row the same whole number of times, and
    those with the least hashes once more. Drawing with replacement, as elsewhere, would draw some rows far more often
    than others for no use. The order within an epoch is ``batch_plan``'s.
    """
    ratio = max(0.0, min(0.95, ratio))
    n_target, n_pool = target.count(), pool.count()
    need = round(n_target * ratio / (1 - ratio)) if n_pool else 0
    whole, rest = divmod(need, n_pool) if n_pool else (0, 0)
    mine = target.select(F.lit("target").alias("kind"), key, F.lit(1).alias("copies"))
    hashed = pool.select(key, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("_h"))
    more = least_hashes(hashed, "_h", key, rest).select(key, F.lit(1).alias("_more"))
    drawn = hashed.join(more, key, "left").select(F.lit("replay").alias("kind"), key, (F.lit(whole) + F.coalesce("_more", F.lit(0))).alias("copies"))
    return mine.unionByName(drawn.filter("copies > 0"))


def batch_plan(rows: DataFrame, group: str, size: str, tie: str, batch: int) -> DataFrame:
    """Adds ``batch``: neighbours by size in each group, ``batch`` rows at a time; a group is a shard of the epoch."""
    order = Window.partitionBy(group).orderBy(size, tie)
    return rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / batch))


def truncated_pairs(prompts: DataFrame, targets: DataFrame, key: str, budget: int, least: int) -> DataFrame:
    """key, prompt, target, frames: each target cut to what its prompt leaves of the budget; too short ones go."""
    both = prompts.select(key, "prompt", F.col("frames").alias("_p")).join(targets.select(key, "target", F.col("frames").alias("_t")), key)
    left = F.least(F.col("_t"), budget - F.col("_p"))
    return both.withColumn("frames", left).filter(F.col("frames") >= least).select(key, "prompt", "target", "frames")


def preset_ladder(minutes: Column) -> Column:
    """Names of presets in order of preference, by minutes of material."""
    m = F.coalesce(minutes, F.lit(0.0))
    names = lambda *ns: F.array(*map(F.lit, ns))
    return F.when(m < 5, names("conservative", "balanced")).when(m < 8, names("balanced", "expressive", "conservative")).when(m < 30, names("expressive", "balanced", "aggressive")).otherwise(names("expressive", "aggressive", "balanced"))


def eval_every(steps: Column, top_k: int) -> Column:
    """Steps between two evaluations, so that about ``top_k`` of them fit; 0 without steps."""
    return F.when(steps > 0, F.greatest(F.lit(1), F.floor(steps / (max(1, top_k) + 1)).cast("int"))).otherwise(0)


def band_sample(low: Column, high: Column, key: Column, seed: int = 0) -> Column:
    """A value between two quantiles, by hash of the key."""
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 7), 16, 10).cast("double") / float(16**7)
    return low + (high - low) * part


def padded(values: Column, width: Column, fill) -> Column:
    """An array filled up to ``width``."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), width - F.size(values))))


def hash_chain(parts: Column) -> Column:
    """A digest over an array in order: each link hashes the one before and the next part."""
    return F.aggregate(parts, F.lit(""), lambda h, p: F.sha2(F.concat(h, F.lit("|"), p), 256))
