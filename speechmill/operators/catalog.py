"""Catalogs of files, runs and artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collect_inputs(paths: DataFrame, listing: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """path, ord, verdict of rows (path, ord): each path once, at its first place; kept, missing or skipped.

    A path that no row of ``listing`` (path) has is missing; one of another kind than ``kinds`` is skipped.
    """
    once = paths.groupBy("path").agg(F.min("ord").alias("ord"))
    here = listing.select("path").distinct().withColumn("_here", F.lit(True))
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    verdict = F.when(F.col("_here").isNull(), "missing").when(~kind.isin(*kinds), "skipped").otherwise("kept")
    return once.join(here, "path", "left").select("path", "ord", verdict.alias("verdict"))


def path_parts(path: Column, names: dict[str, int]) -> list[Column]:
    """Partition values from the segments of a path, counted from the end (1: the last)."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^[a-z]+://|[?#].*$", ""), "/"), lambda p: p != "")
    return [F.try_element_at(parts, F.lit(-k)).alias(n) for n, k in names.items()]


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the keys of ``gone``; a null key is never gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def folder_stats(files: DataFrame, root: Column, size: str, time: str) -> DataFrame:
    """root, bytes, files, newest."""
    return files.groupBy(root.alias("root")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("files"), F.max(time).alias("newest"))


def keep_best(rows: DataFrame, group: str, metric: str, step: str, keep: int) -> DataFrame:
    """The ``keep`` rows of each group with the least metric (ties: the earlier step), nulls and NaN last."""
    order = Window.partitionBy(group).orderBy(F.asc_nulls_last(F.nanvl(F.col(metric), F.lit(None))), step)
    return rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= keep).drop("_place")


def ranked_candidates(rows: DataFrame, group: str, reward: str, val: str, tie: str) -> DataFrame:
    """Adds ``place``: by reward, highest first, then by val, nulls and NaN last."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(reward), F.asc_nulls_last(F.nanvl(F.col(val), F.lit(None))), tie)
    return rows.withColumn("place", F.row_number().over(order))


def improvement(history: DataFrame, group: str, step: str, loss: str) -> DataFrame:
    """group, first, best, improved: 1 - best / first, null without a positive first loss."""
    runs = history.groupBy(group).agg(F.min_by(loss, step).alias("first"), F.min(loss).alias("best"))
    return runs.withColumn("improved", F.when(F.col("first") > 0, 1 - F.col("best") / F.col("first")))


def totals_by_kind(artifacts: DataFrame, kind: str, size: str, deletable: Column) -> DataFrame:
    """kind (null: all), n, bytes, deletable_bytes."""
    return artifacts.rollup(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.coalesce(F.sum(F.when(deletable, F.col(size))), F.lit(0)).alias("deletable_bytes"))


def grouped_layers(rows: DataFrame, pattern: Column, name: str, size: str) -> DataFrame:
    """pattern, n, total, examples: the two least names of each group. Only two rows of a group reach the array."""
    marked = rows.select(pattern.alias("pattern"), name, size)
    sums = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"))
    order = Window.partitionBy("pattern").orderBy(name)
    first = marked.withColumn("_k", F.row_number().over(order)).filter("_k <= 2").groupBy("pattern").agg(F.array_sort(F.collect_list(name)).alias("examples"))
    return sums.join(first, "pattern")


def norm_drift(cells: DataFrame, layer: str, delta: str, weight: str) -> DataFrame:
    """layer, drift: the norm of a layer's change over its norm; layer null: over all layers."""
    sums = cells.groupBy(layer).agg(F.sum(F.col(delta) * F.col(delta)).alias("_d"), F.sum(F.col(weight) * F.col(weight)).alias("_w"))
    every = sums.rollup(layer).agg(F.sum("_d").alias("_d"), F.sum("_w").alias("_w"))
    return every.select(layer, (F.sqrt("_d") / F.sqrt("_w")).alias("drift"))


def resolve_patterns(wanted: DataFrame, known: DataFrame, dead: DataFrame) -> DataFrame:
    """The known patterns that a wanted one names, * standing for anything, less the dead ones. ``wanted`` is a short list."""
    like = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("want", r"([.+?()\[\]{}^$|\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    patterns = [r[0] for r in wanted.select(like).distinct().limit(1001).collect()]
    if len(patterns) > 1000:
        raise ValueError("more than 1000 wanted patterns")
    if not patterns:
        return known.limit(0)
    return known.filter(F.col("pattern").rlike("|".join(sorted(patterns)))).distinct().join(dead, "pattern", "left_anti")


def version_fits(got: Column, want: str) -> Column:
    """``==``, ``>=`` (numbers by place, others count as 0) and a final ``.*``; anything else is a beginning."""
    want = want.strip()
    have = F.coalesce(got, F.lit(""))
    if want.endswith(".*"):
        fits = have.startswith(want[:-2])
    elif want.startswith(">="):
        parts = [int(p) if p.isdigit() else 0 for p in want[2:].strip().split(".")]
        mine = F.transform(F.split(have, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), p.cast("int")).otherwise(0))
        least = F.array(*map(F.lit, parts))
        width = F.greatest(F.size(mine), F.lit(len(parts)))
        padded = lambda a: F.concat(a, F.array_repeat(F.lit(0), width - F.size(a)))
        fits = padded(mine) >= padded(least)
    elif want.startswith("=="):
        fits = have == want[2:]
    else:
        fits = have.startswith(want)
    return (have != "") & fits


def path_conflicts(outputs: DataFrame, inputs: DataFrame, path: str) -> DataFrame:
    """The outputs whose path, without doubled or final slashes and single dots, is also an input."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"/(\./)+", "/"), "/+", "/"), "(.)/$", "$1")
    taken = inputs.select(plain(F.col(path)).alias("_p")).distinct()
    return outputs.withColumn("_p", plain(F.col(path))).join(taken, "_p", "left_semi").drop("_p")


def backfilled(rows: DataFrame, measured: DataFrame, key: str, field: str) -> DataFrame:
    """Rows with the measured field where it was missing; a second run changes nothing. ``measured`` has a key once."""
    found = measured.select(key, F.col(field).alias("_m"))
    return rows.join(found, key, "left").withColumn(field, F.coalesce(field, "_m")).drop("_m")


def latest_by_name(versions: DataFrame, name: Column, version: str) -> DataFrame:
    """name, entry: the row of the highest version of each name; a name of no letter or digit is left out."""
    rows = versions.withColumn("_name", name).filter("_name != ''")
    return rows.groupBy(F.col("_name").alias("name")).agg(F.max(F.struct(version, *[c for c in versions.columns if c != version])).alias("entry"))


def json_number(raw: Column, field: str, low: int, high: int, fallback: Column) -> Column:
    """A whole number out of the first {...} of an answer, if it is there and within bounds, else the rule's."""
    value = F.get_json_object(F.regexp_extract(raw, r"(?s)\{.*\}", 0), f"$.{field}").try_cast("int")
    return F.when(value.between(low, high), value).otherwise(fallback)


def table_lines(rows: DataFrame, columns: list[str], order: list[Column], most: int, only: Column | None = None) -> DataFrame:
    """line: the first ``most`` rows in order as lines of a Markdown table, bars escaped, nulls as a dash."""
    shown = rows if only is None else rows.filter(only)
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))
    return shown.orderBy(*order).limit(most).select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
