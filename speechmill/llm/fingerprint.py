"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so the sketch of a union
is the union of sketches and a short document can be measured against a very long one. A document with fewer
than ``floor`` hashes below the threshold keeps its ``floor`` lowest hashes instead (all, if it has no more);
``level`` says up to which hash a sketch is complete, and two sketches are compared below the lower level.

Defined cases: a null text counts as empty; a text without words has an empty sketch, which is like another
empty sketch to 1 and like any other to 0; fewer words than a shingle make one shingle of all of them; equal
texts have equal sketches; repeated rows have one result each, and rows of one doc_id follow each other by text; a very
long text is one row, whose hashes are an array in its task; an empty table gives no rows; columns other than doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_CLASS, text_or_empty

SHINGLE_WORDS, FRACTION, FLOOR = 5, 0.25, 64
MAX_HASH = (1 << 63) - 1

#: Documents in a block of neighbours by doc_id, and blocks at most; beyond that blocks hold more documents.
BLOCK_ROWS, MAX_BLOCKS = 512, 10_000


def _word_hashes(text: Column) -> Column:
    trimmed = F.regexp_replace(F.lower(text), rf"^{WHITE_CLASS}+|{WHITE_CLASS}+$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"{WHITE_CLASS}+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle_hashes(name: str, width: int) -> Column:
    """Hashes from 0 to MAX_HASH of all runs of ``width`` words; ``name`` is a column of word hashes."""
    words = F.col(name)
    count = F.size(words)
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]).bitwiseAND(F.lit(MAX_HASH))
    return (
        F.when(count >= width, F.transform(F.sequence(F.lit(0), count - width), run))
        .when(count > 0, F.array(F.xxhash64(words).bitwiseAND(F.lit(MAX_HASH))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def add_sketches(df: DataFrame, columns: dict[str, str], width: int = SHINGLE_WORDS, fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """For each item name -> text column, a column ``name`` of struct<level, hashes> with sorted hashes."""
    threshold = int(fraction * MAX_HASH)
    keep = df.columns
    step = df.select("*", *[_word_hashes(F.col(t)).alias(f"_w_{n}") for n, t in columns.items()])
    step = step.select(*keep, *[_shingle_hashes(f"_w_{n}", width).alias(f"_s_{n}") for n in columns])
    step = step.select(
        *keep, *[f"_s_{n}" for n in columns],
        *[F.sort_array(F.array_distinct(F.filter(f"_s_{n}", lambda x: x < threshold))).alias(f"_k_{n}") for n in columns],
    )
    few = {n: F.size(f"_k_{n}") < floor for n in columns}
    step = step.select(
        *keep, *[f"_k_{n}" for n in columns],
        *[F.when(few[n], F.sort_array(F.array_distinct(f"_s_{n}"))).alias(f"_a_{n}") for n in columns],
    )

    def sketch(n: str) -> Column:
        every = F.col(f"_a_{n}")
        return (
            F.when(every.isNull(), F.struct(F.lit(threshold).alias("level"), F.col(f"_k_{n}").alias("hashes")))
            .when(F.size(every) <= floor, F.struct(F.lit(MAX_HASH).alias("level"), every.alias("hashes")))
            .otherwise(F.struct((F.get(every, F.lit(floor - 1)) + 1).alias("level"), F.slice(every, 1, floor).alias("hashes")))
        )

    return step.select(*keep, *[sketch(n).alias(n) for n in columns])


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    level = F.least(a["level"], b["level"])
    below = [F.filter(x["hashes"], lambda h: h < level) for x in (a, b)]
    both = F.size(F.array_intersect(*below)).cast("double")
    return both, F.size(below[0]).cast("double"), F.size(below[1]).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    both, na, nb = _common(a, b)
    empty = (F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0)
    return F.when(empty, 1.0).otherwise(F.coalesce(both / F.nullif(na + nb - both, F.lit(0.0)), F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds too; null if ``a`` shows none at the common level."""
    both, na, _ = _common(a, b)
    return both / F.nullif(na, F.lit(0.0))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two documents' shingles."""
    level = F.least(a["level"], b["level"])
    return F.struct(level.alias("level"), F.sort_array(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda h: h < level)).alias("hashes"))


def as_string(sketch: Column) -> Column:
    return F.concat(F.hex(sketch["level"]), F.lit(":"), F.array_join(F.transform(sketch["hashes"], lambda h: F.hex(h)), ","))


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, Window]:
    """Documents in blocks of neighbours by descending doc_id, each block with its follower's first row.

    Blocks end at doc_ids that approximate quantiles give, at most ``max_blocks`` of them, so no task sees all rows
    and the texts are shuffled once. Null doc_ids come last; equal doc_ids are ordered by text.
    Returns the blocks (column ``_ghost`` 1: a follower's row) and the window for ``lead``.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    count = docs.count()
    blocks = max(1, min(max_blocks, count // block_rows))
    ends: list[int] = []
    if count:
        row = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks + 1)], max(10_000, 20 * blocks)).alias("q"), F.max("doc_id").alias("top")).first()
        ends = sorted({*(row.q or []), *([row.top] if row.top is not None else [])})
    bounds = F.split(F.lit(",".join(map(str, ends)) or "0"), ",").cast("array<bigint>")
    halves = [1 << k for k in reversed(range(max(1, len(ends).bit_length())))]
    ask = F.col("doc_id")
    block = F.when(ask.isNull(), 0).otherwise(
        F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda at, h: F.when((at + h <= len(ends)) & (F.get(bounds, at + h - 1) < ask), at + h).otherwise(at))
    )
    docs = docs.withColumn("_block", block)
    place = lambda at, ghost: F.struct(at.cast("int").alias("block"), F.lit(ghost).alias("ghost"))
    own, up = place(F.col("_block"), 0), place((F.col("_block") + 1) % max(1, len(ends)), 1)
    first = F.get(bounds, F.col("_block")).eqNullSafe(ask) if ends else F.lit(True)
    placed = docs.select("doc_id", "text", F.explode(F.when(first, F.array(own, up)).otherwise(F.array(own))).alias("_at"))
    placed = placed.select("doc_id", "text", F.col("_at.block").alias("_block"), F.col("_at.ghost").alias("_ghost"))
    return placed, Window.partitionBy("_block").orderBy("_ghost", F.desc_nulls_last("doc_id"), "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketches of a text and of its edit, likeness of both and to the next text.

    The edit replaces the last third of the code points by as many first ones of the next document.
    """
    placed, order = with_next(docs)
    chars = F.char_length("text")
    cut = F.floor(chars / 3).cast("int")
    step = placed.withColumn("_next", F.lead("text").over(order))
    step = step.select("doc_id", "text", "_block", "_ghost", chars.cast("bigint").alias("n_chars"), F.concat(F.col("text").substr(F.lit(1), chars - cut), F.col("_next").substr(F.lit(1), cut)).alias("_edited"))
    step = add_sketches(step, {"sketch": "text", "edited_sketch": "_edited"})
    step = step.withColumn("_next_sketch", F.lead("sketch").over(order)).filter("_ghost = 0")
    return step.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("_next_sketch")).alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    done = edited_pairs(docs)
    return done.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
