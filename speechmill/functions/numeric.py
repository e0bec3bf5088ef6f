"""Functions on numbers and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights by which eight emotions are toned down, and the most they may sum to.
EMOTION_BIAS = (0.9375, 0.875, 1.0, 1.0, 0.9375, 0.9375, 0.6875, 0.5625)
EMOTION_LIMIT = 0.8


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row.

    What stands in a lambda is worked out for each element, so a lambda over n elements that holds a sum over them is
    quadratic, and one inside it cubic. Likewise a value that is used twice may be worked out twice.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def scaled_round(x: Column, digits: int) -> Column:
    """Halves away from zero, of the product with a power of ten, as C and SQL engines built on it round; ``round`` here rounds the printed number."""
    scaled = F.abs(x) * float(10**digits)
    whole = F.floor(scaled)
    return F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / float(10**digits)


def between(low: Column, high: Column, share: Column) -> Column:
    """fma(low, 1 - share, high * share), rounded once, as DuckDB rounds quantiles between two values.

    So a value that equals the quantile in decimals is above it here where it is above it there.
    """
    there = low.isNotNull() & high.isNotNull() & share.isNotNull()
    return F.when(there, F.when(share == 0, low).otherwise(F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")))


def sorted_quantile(ordered: Column, share: float) -> Column:
    """The quantile of a sorted array; null for an empty one."""
    at = (F.size(ordered) - 1) * F.lit(share)
    return between(F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int")), at - F.floor(at))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def tone_down(vector: Column, bias: bool = True) -> Column:
    """An emotion vector, weighted and scaled to sum to at most EMOTION_LIMIT."""
    weighted = F.zip_with(vector, F.array(*map(F.lit, EMOTION_BIAS)), lambda x, b: x * b) if bias else vector
    return once(total(weighted), lambda sum_: F.when(sum_ > EMOTION_LIMIT, F.transform(weighted, lambda x: x * EMOTION_LIMIT / sum_)).otherwise(weighted))


def emotion_vector(text: Column) -> Column:
    """Eight numbers from 0 to 1 that sum to at most 0.8, from text; null if the text is anything else."""
    parts = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    good = (F.size(parts) == 8) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)) & (total(parts) <= EMOTION_LIMIT + 1e-9)
    return F.when(good, parts)


def shift_list(text: Column) -> Column:
    """Whole numbers from -18 to 18 without 0; full-width commas and minus signs count, other items are dropped."""
    parts = F.transform(F.split(F.translate(text, "，－−", ",--"), ","), lambda x: F.trim(x).try_cast("int"))
    return F.filter(parts, lambda n: n.isNotNull() & n.between(-18, 18) & (n != 0))


def human_size(size: Column) -> Column:
    out = None
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        shown = F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))
        out = shown if out is None else F.when(size < 1024 ** (k + 1), shown).otherwise(out)
    return out


def stable_seed(base: int, key: Column) -> Column:
    return F.lit(base) + F.crc32(key.cast("string").cast("binary")) % 100_000
