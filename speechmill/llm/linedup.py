"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions only.

Lines that occur once part the documents into segments; only segments of ``min_words`` words or more can hold a
repeated run. A suffix is a place in a segment. Its rank is first that of its line (128 bits of hash), and then
doubles: suffixes that agree on 2^k lines are ranked anew by the rank 2^k lines on, until each is alone with its rank or
compared to its end. A rank is the number of smaller suffixes, so those that are settled keep theirs, and segments
that are settled leave the rounds. Ranks come from sorted range partitions, running sums in them, and the partitions' totals.

In suffix order, the longest common prefix of neighbours is counted in lines, as far as any interval asked for
reaches. Each line asks for the shortest run of ``min_words`` words that starts with it, and for the one that ends
with it; these cover every repeated run of so many words to its last line. The suffixes that share such a run are an
interval: neighbours without a smaller prefix between them. In each interval the first copy in (doc_id, line) order
stays; later runs that touch in a document join to maximal runs, and these are deleted.

Sums are combined before each shuffle, and joins split hot lines; no task gathers an interval. What is broadcast has
one row, or one for each run length below ``min_words``, for each shuffle partition. Defined cases: lines without
words are not counted and, where a document loses lines, dropped; a null text is left alone and an empty one has no
lines; rows with equal doc_id and text are one document, so both stay or lose the same lines; texts under one doc_id
are told apart by hash; null doc_ids come first; an empty table gives no rows; a very long text is one row, its
lines are ranked like any others, and the window over them is one task; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, text_or_empty

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
_DOC = ("doc_id", "version")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_words(line: Column) -> Column:
    return line.rlike(_WORD)


def line_places(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, line number among lines with words, line ID (two hashes), and words."""
    worded = F.filter(_lines(text_or_empty()), _has_words)
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("version"), F.posexplode(worded).alias("line", "_text"))
    return lines.select(*_DOC, "line", F.xxhash64("_text").alias("one"), F.xxhash64(F.lit(1), "_text").alias("two"), F.regexp_count("_text", F.lit(_WORD)).cast("bigint").alias("words"))


def _ranked(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` (keys, count) with ``before``: the sum of ``count`` over all rows with smaller keys. Keys are distinct."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    placed = scratch.keep(placed, name)
    totals = placed.groupBy("_part").agg(F.sum("count").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    running = F.sum("count").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("before", F.coalesce(running, F.lit(0))).join(F.broadcast(offsets), "_part")
    return placed.select(*rows.columns, (F.col("before") + F.col("_offset")).alias("before"))


def segments(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """doc_id, version, segment, line, words, rank: the lines of segments that can hold a repeated run."""
    lines = line_places(docs)
    repeated = lines.groupBy("one", "two").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    ranks = _ranked(repeated, ["one", "two"], scratch, "line-ids").select("one", "two", F.col("before").alias("rank"))
    lines = lines.join(ranks, ["one", "two"]).select(*_DOC, "line", "words", "rank")
    order = Window.partitionBy(*_DOC).orderBy("line")
    lines = lines.withColumn("_last", F.lag("line").over(order)).filter("_last is null or _last <> line").drop("_last")  # a repeated row
    lines = lines.withColumn("segment", F.col("line") - F.row_number().over(order))
    whole = Window.partitionBy(*_DOC, "segment")
    lines = lines.withColumn("_words", F.sum("words").over(whole)).filter(F.col("_words") >= min_words).drop("_words")
    return scratch.keep(lines.withColumn("lines", F.count(F.lit(1)).over(whole.orderBy(F.col("line").desc()))), "lines")


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, version, line, rank of every suffix, by prefix doubling. Equal ranks: equal to their ends."""

    def frame(rows: DataFrame, ahead: int) -> DataFrame:
        """The rank ``ahead`` lines on (-1: past the end) of open suffixes, and whether the segment has any of them."""
        segment = Window.partitionBy(*_DOC, "segment")
        next_rank = F.coalesce(F.lead("rank", ahead).over(segment.orderBy("line")), F.lit(-1))
        return rows.select(*_DOC, "segment", "line", "lines", "rank", F.when(F.col("open"), next_rank).alias("next"), F.max("open").over(segment).alias("live"))

    turn = 0
    rows = scratch.keep(frame(lines.withColumn("open", F.lit(True)), 1), f"frame-{turn}")
    done = rows.filter("not live").select(*_DOC, "line", "rank")
    while not rows.filter("live").isEmpty():
        live = rows.filter("live")
        groups = live.filter("next is not null").groupBy("rank", "next").agg(F.count(F.lit(1)).alias("count"))
        groups = _ranked(groups, ["rank", "next"], scratch, f"pairs-{turn}")
        start = groups.groupBy("rank").agg(F.min("before").alias("_start"))
        groups = groups.join(start, "rank").select("rank", "next", "count", (F.col("rank") + F.col("before") - F.col("_start")).alias("_new"))
        # Settled: alone, or compared past its end.
        is_open = (F.col("count") > 1) & (F.col("lines") >= 2 << turn)
        moved = live.join(groups, ["rank", "next"], "left").select(*_DOC, "segment", "line", "lines", F.coalesce("_new", "rank").alias("rank"), F.coalesce(is_open, F.lit(False)).alias("open"))
        turn += 1
        rows = scratch.keep(frame(moved, 1 << turn), f"frame-{turn}")
        scratch.drop(f"pairs-{turn - 1}")
        done = done.unionByName(rows.filter("not live").select(*_DOC, "line", "rank"))
    return done


def asked_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version, line, sizes, head: the numbers of lines of the runs asked for from a line, and the IDs of the longest."""
    segment = Window.partitionBy(*_DOC, "segment")
    before = F.sum("words").over(segment.orderBy("line")) - F.col("words")
    rows = lines.withColumn("before", before).withColumns({"after": F.col("before") + F.col("words"), "total": F.sum("words").over(segment)})
    ahead = F.count(F.lit(1)).over(segment.orderBy("before").rangeBetween(0, min_words - 1))
    back = F.count(F.lit(1)).over(segment.orderBy("after").rangeBetween(-(min_words - 1), 0))
    head = F.collect_list("rank").over(segment.orderBy("line").rowsBetween(0, min_words - 1))
    rows = rows.select(*_DOC, "line", head.alias("head"), F.when(F.col("total") - F.col("before") >= min_words, ahead).alias("ahead"), F.when(F.col("after") >= min_words, back).alias("back"))
    runs = F.array(F.struct("line", F.col("ahead").alias("size"), F.lit(True).alias("own")), F.struct((F.col("line") - F.col("back") + 1).cast("int").alias("line"), F.col("back").alias("size"), F.lit(False).alias("own")))
    asked = rows.select(*_DOC, "head", F.explode(runs).alias("run")).filter("run.size is not null or run.own")
    asked = asked.groupBy(*_DOC, "run.line").agg(F.array_compact(F.collect_set(F.col("run.size").cast("int"))).alias("sizes"), F.max(F.when(F.col("run.own"), F.col("head"))).alias("head"))
    return asked.filter(F.size("sizes") > 0).select(*_DOC, "line", "sizes", F.slice("head", F.lit(1), F.array_max("sizes")).alias("head"))


def intervals(lines: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """doc_id, version, line, size, interval: equal (size, interval) where the next ``size`` lines are equal."""
    ranks = suffix_ranks(lines, scratch).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("line").alias("_line"), "rank")
    asked = asked_runs(lines, min_words)
    suffixes = asked.join(ranks, asked["doc_id"].eqNullSafe(ranks["_id"]) & (asked["version"] == ranks["_version"]) & (asked["line"] == ranks["_line"])).select(*asked.columns, "rank")
    order = ["rank", *_DOC, "line"]
    array = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).select(*asked.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    array = scratch.keep(array, "suffix-array")
    ends = array.groupBy("part").agg(F.max_by("head", "at").alias("_end"))
    ends = ends.select("part", F.lag("_end").over(Window.orderBy("part")).alias("_end"))  # over one row for each partition
    in_part = Window.partitionBy("part").orderBy("at")
    last = F.coalesce(F.lag("head").over(in_part), "_end")
    unequal = F.array_position(F.zip_with("head", "_last", lambda a, b: a.eqNullSafe(b)), False) - 1
    # Without an unequal place one head is the other's beginning: the common prefix is the shorter.
    common = F.when(F.col("_last").isNull(), 0).when(unequal >= 0, unequal).otherwise(F.size("head"))
    rows = array.join(F.broadcast(ends), "part").withColumn("_last", last).withColumn("common", common)
    rows = rows.select(*_DOC, "line", "part", "at", "common", F.explode("sizes").alias("size"))
    starts = F.when(F.col("common") < F.col("size"), F.col("at"))
    rows = rows.withColumn("start", F.max(starts).over(Window.partitionBy("part", "size").orderBy("at")))
    carried = rows.groupBy("part", "size").agg(F.max(starts).alias("_start"))
    carried = carried.select("part", "size", F.max("_start").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    rows = rows.join(F.broadcast(carried), ["part", "size"], "left")
    return rows.select(*_DOC, "line", "size", F.coalesce("start", "_start").alias("interval"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs of lines that stand earlier too: doc_id, version, line, lines, and where the first line's copy is."""
    kept, scratch = Scratch(docs.sparkSession, "linedup-intervals"), Scratch(docs.sparkSession, "linedup")
    asked = kept.keep(intervals(segments(docs, min_words, scratch), min_words, scratch), "whole")
    scratch.drop_all()
    place = F.struct("doc_id", "line", "version")
    first = asked.groupBy("size", "interval").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("size", "interval", "first")
    first = kept.keep(first, "first")  # written, so that the join below can split hot intervals
    later = asked.join(first, ["size", "interval"]).filter(place > F.col("first")).select(*_DOC, "line", (F.col("line") + F.col("size")).alias("end"), "first")
    order = Window.partitionBy(*_DOC).orderBy("line", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("_new", F.when(reach >= F.col("line"), 0).otherwise(1))
    later = later.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy(*_DOC, "_run").agg(F.min("line").alias("line"), F.max("end").alias("end"), F.min(F.struct("line", "first")).alias("f"))
    return runs.select(*_DOC, "line", (F.col("end") - F.col("line")).cast("int").alias("lines"), F.col("f.first.doc_id").alias("first_doc_id"), F.col("f.first.line").alias("first_line"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, str, str] = ("n_lines", "n_deleted", "n_runs")) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` freed of later copies, and counts under ``names``."""
    runs = repeated_runs(docs, min_words).groupBy("doc_id", "version").agg(F.collect_list(F.struct("line", "lines")).alias("runs"))
    version, found, lines = fresh(docs, "version"), fresh(docs, "runs"), fresh(docs, "lines")
    key = F.col("doc_id").cast("bigint")
    left = docs.withColumn(version, F.xxhash64(text_or_empty()))
    right = runs.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("runs").alias("_runs"))
    joined = left.join(right, key.eqNullSafe(right["_id"]) & (left[version] == right["_version"]), "left")
    joined = joined.select(*[left[c] for c in left.columns], right["_runs"].alias(found))
    words = F.filter(_lines(text_or_empty()), _has_words)
    joined = joined.withColumn(lines, words)
    kept = F.filter(F.col(lines), lambda _, i: ~F.exists(F.col(found), lambda r: (i >= r["line"]) & (i < r["line"] + r["lines"])))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.aggregate(found, F.lit(0), lambda s, r: s + r["lines"]), F.lit(0))
    counts = [F.size(lines).cast("bigint"), gone.cast("bigint"), F.coalesce(F.size(found), F.lit(0)).cast("bigint")]
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(counts, names, strict=True)])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies of runs deleted and ``n_chars`` renewed; one that loses all its lines goes."""
    names = (fresh(docs, "n_lines"), fresh(docs, "n_deleted"), fresh(docs, "n_runs"))
    done = dedup_lines(docs, min_words, names).filter((F.col(names[1]) == 0) | (F.col(names[1]) < F.col(names[0])))
    columns = [F.when(F.col(names[1]) > 0, F.char_length("text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*columns)
