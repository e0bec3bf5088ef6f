"""Source divergence audit: how far the term shares of a language's sources are from each other and from the language's.

Terms are counted by (lang, source) in the tasks that read the texts, and added up. A language keeps the terms of
``LEAST_DOCS`` documents or more. Each group gives every kept term the smoothed share
p = 1 + floor(SHARES (count + 5) / (N + 5 V)), in whole numbers.

Pairs are tiled in two dimensions. Groups are dealt into blocks and terms into vocabulary chunks; the counts of one
block in one chunk are packed into one row. A tile is a pair of blocks and a span of chunks: each block's rows are
replicated to its tiles, and a tile adds up its pair submatrix chunk after chunk, over the terms that either block has.
The terms that neither has all differ by the same amount, which is multiplied by their number when a pair's tiles are
added up. So a task holds two blocks' counts in one chunk, whatever the numbers of groups and terms; a language that
holds a third of the groups is more tiles, a source that holds a third of the documents is counted where it is read.

Defined cases: null text, lang or source count as ''; repeated rows are documents of their own; a group without
kept terms, and one alone in its language, has its rows of part ``pair`` (none if alone); a language without kept
terms has value 0; equal values are ranked by the item's UTF-8 bytes; a very long text is counted in pieces, its
terms whole; counts are exact up to 9e13 for a group; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, slices, text_or_empty, utf8_values

LEAST_DOCS, SMOOTH, TOP_TERMS = 30, 5, 50
#: Shares are of a billion, taken in two steps so that products stay within 64 bits.
FIRST, SECOND = 100_000, 10_000
BLOCK_GROUPS, CHUNK_TERMS, SPAN_CHUNKS, HELD_TERMS, PIECE = 64, 4096, 64, 400_000, 1 << 20

#: Terms are runs of ASCII letters and of all bytes beyond ASCII; A-Z count as a-z.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64()), ("docs", pa.int64())])
PACKED = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])
TILE = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("seen", pa.int64()), ("apart", pa.int64())])


def pieces(text: bytes, size: int = PIECE):
    """A text's terms, in lists of what about ``size`` bytes hold."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and _TERM[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_TERM).split()
        at = end


def _counted(batches):
    """Terms of a task's documents by group; a row without term stands for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), k) for x, k in ((lang, pa.string()), (source, pa.string()))] + [pa.array(some, pa.binary()), pa.array([counts[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], schema=COUNTS)

    for batch in batches:
        for part in slices([batch], 200):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), utf8_values(part.column("text")), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter({b"": 0}), Counter()
                counts, docs = held[lang, source]
                before = len(counts)
                once: set[bytes] = set()
                for terms in pieces(text):
                    counts.update(terms)
                    once.update(terms)
                docs.update(once)
                size += len(counts) - before
                if size > HELD_TERMS:
                    yield from flush()
                    held, size = {}, 0
    yield from flush()


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(1e9 (count + 5) / (total + 5 terms)) in whole numbers."""
    a, m = f"({count} + {SMOOTH})", f"({total} + {SMOOTH} * {terms})"
    return F.expr(f"1L + ({a} * {FIRST}L div {m}) * {SECOND}L + ({a} * {FIRST}L % {m}) * {SECOND}L div {m}")


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same for arrays."""
    m = np.maximum(total + SMOOTH * terms, 1)
    high, rest = np.divmod((count + SMOOTH) * FIRST, m)
    return 1 + high * SECOND + rest * SECOND // m


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The counts of a block in a chunk: places of groups, places of terms, counts."""
    lang, block, chunk = (k.as_py() for k in key)
    raw = b"".join(np.ascontiguousarray(rows.column(c).to_numpy(), np.int64).tobytes() for c in ("place", "word", "count"))
    return pa.Table.from_pylist([{"lang": lang, "block": block, "chunk": chunk, "counts": raw}], PACKED)


class _Block:
    """Groups of a block with their totals, and their counts in the present chunk."""

    def __init__(self, row: dict):
        self.names, self.totals, self.terms = row["sources"], np.array(row["totals"], np.int64), row["terms"]
        self.chunk, self.counts = None, None

    def take(self, row: dict) -> None:
        self.chunk, self.counts = row["chunk"], np.frombuffer(row["counts"], np.int64).reshape(3, -1)

    def words(self, chunk: int) -> np.ndarray:
        return np.unique(self.counts[1]) if self.chunk == chunk else np.zeros(0, np.int64)

    def shares(self, chunk: int, words: np.ndarray) -> np.ndarray:
        """The shares of ``words`` in each group."""
        count = np.zeros((len(self.names), len(words)), np.int64)
        if self.chunk == chunk:
            count[self.counts[0], np.searchsorted(words, self.counts[1])] = self.counts[2]
        return shares(count, self.totals[:, None], self.terms)

    def unseen(self) -> np.ndarray:
        return shares(np.zeros(len(self.names), np.int64), self.totals, self.terms)


class _Tile:
    """A pair of blocks, or one block with itself; nothing comes of a pair of which a language has but one block."""

    def __init__(self, lang: str, alone: bool):
        self.lang, self.alone, self.sides = lang, alone, {}
        self.sums, self.seen = None, 0

    def whole(self) -> bool:
        return self.alone or len(self.sides) == 2

    def ready(self) -> tuple[_Block, _Block]:
        one, other = self.sides[0], self.sides[0 if self.alone else 1]
        if self.sums is None:
            self.sums = np.zeros((len(one.names), len(other.names)), np.int64)
        return one, other

    def add(self, chunk: int) -> None:
        one, other = self.ready()
        words = np.union1d(one.words(chunk), other.words(chunk))
        p, q = one.shares(chunk, words), other.shares(chunk, words)
        for i in range(len(p)):
            self.sums[i] += np.abs(q - p[i]).sum(axis=1)
        self.seen += len(words)

    def rows(self) -> list[pa.RecordBatch]:
        one, other = self.ready()
        apart = np.abs(one.unseen()[:, None] - other.unseen()[None, :])
        a, b = np.indices(self.sums.shape)
        keep = (a != b) if one is other else np.ones_like(a, bool)
        a, b, value, apart = a[keep], b[keep], self.sums[keep], apart[keep]
        names = np.array(one.names, object)[a], np.array(other.names, object)[b]
        columns = [(names[0], names[1])] if one is other else [names, names[::-1]]
        n = len(a)
        return [pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(value), pa.array(np.full(n, self.seen)), pa.array(apart)], schema=TILE) for x, y in columns]


def _tiles(batches):
    """Rows come sorted by tile, then chunk (-1: the groups), then side."""
    key = tile = None
    last = -1
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            now = (row["lang"], row["lo"], row["hi"], row["span"])
            if now != key:
                if tile is not None:
                    yield from _ended(tile, last)
                key, tile, last = now, _Tile(row["lang"], row["lo"] == row["hi"]), -1
            if row["chunk"] < 0:
                tile.sides[row["side"]] = _Block(row)
                continue
            if not tile.whole():
                continue
            if row["chunk"] != last and last >= 0:
                tile.add(last)
            last = row["chunk"]
            tile.sides[row["side"]].take(row)
    if tile is not None:
        yield from _ended(tile, last)


def _ended(tile: _Tile, last: int):
    if tile.whole():
        if last >= 0:
            tile.add(last)
        yield from tile.rows()


def pair_values(kept: DataFrame, groups: DataFrame, block_groups: int = BLOCK_GROUPS, chunk_terms: int = CHUNK_TERMS, span_chunks: int = SPAN_CHUNKS) -> DataFrame:
    """lang, a, b and value for each ordered pair of sources of a language.

    kept: lang, source, term, count. groups: lang, source, total (kept occurrences), terms (kept terms of the language).
    """
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("terms").alias("v")).agg(F.max("n").alias("n"), F.max("v").alias("v")).first()
    blocks, chunks = -(-(most.n or 1) // block_groups), max(1, -(-(most.v or 0) // chunk_terms))
    spans = -(-chunks // span_chunks)
    block = F.pmod(F.xxhash64("source", F.lit(3)), F.lit(blocks)).cast("int")
    placed = groups.withColumn("block", block).withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1)
    words = kept.select("lang", "term").distinct().withColumn("chunk", F.pmod(F.xxhash64("term", F.lit(4)), F.lit(chunks)).cast("int"))
    words = words.withColumn("word", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    counts = kept.join(words, ["lang", "term"]).join(placed.select("lang", "source", "block", "place"), ["lang", "source"])
    packed = counts.select("lang", "block", "chunk", "place", "word", "count").groupBy("lang", "block", "chunk").applyInArrow(_pack, from_arrow_schema(PACKED))
    heads = placed.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("place", "source", "total"))).alias("g"), F.max("terms").alias("terms"))
    nothing = {"sources": "array<string>", "totals": "array<bigint>", "terms": "bigint"}
    heads = heads.select("lang", "block", F.lit(-1).alias("chunk"), F.lit(None).cast("binary").alias("counts"), F.transform("g", lambda g: g["source"]).alias("sources"), F.transform("g", lambda g: g["total"]).alias("totals"), "terms", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"))
    packed = packed.select("*", *[F.lit(None).cast(k).alias(n) for n, k in nothing.items()], F.floor(F.col("chunk") / span_chunks).cast("int").alias("span"))
    rows = heads.unionByName(packed).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other"), "side": (F.col("block") > F.col("_other")).cast("int")})
    tiles = rows.repartition("lang", "lo", "hi", "span").sortWithinPartitions("lang", "lo", "hi", "span", "chunk", "side")
    found = tiles.select("lang", "lo", "hi", "span", "chunk", "side", "counts", "sources", "totals", "terms").mapInArrow(_tiles, from_arrow_schema(TILE))
    sums = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("apart").alias("apart"))
    terms = groups.groupBy("lang").agg(F.max("terms").alias("terms"))
    return sums.join(terms, "lang").select("lang", "a", "b", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("apart")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, **tiling: int) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. ``tiling``: block_groups, chunk_terms, span_chunks."""
    group = ["lang", "source"]
    texts = docs.select(*[text_or_empty(c).alias(c) for c in group], text_or_empty().alias("text"))
    counted = texts.mapInArrow(_counted, from_arrow_schema(COUNTS)).groupBy(*group, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"in_lang": F.sum("count").over(of_lang), "docs": F.sum("docs").over(of_lang), "first": F.row_number().over(of_lang.orderBy("source")) == 1})
    # A row without term stands for its group; terms themselves are never empty.
    scratch = Scratch(docs.sparkSession, "divergence")
    kept = scratch.keep(counted.filter((F.col("term") == b"") | (F.col("docs") >= least_docs)).drop("docs"), "kept")
    none = F.col("term") == b""
    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.sum((F.col("first") & ~none).cast("bigint")).alias("terms"))
    groups = kept.groupBy(*group).agg(F.sum("count").alias("total")).join(langs, "lang")
    groups = scratch.keep(groups, "groups")
    kept = kept.filter(~none)
    pairs = pair_values(kept.select(*group, "term", "count"), groups, **tiling).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    p, q = share("count", "total", "terms"), share("in_lang", "lang_total", "terms")
    terms = kept.join(groups, group).withColumn("value", p - q).filter("value > 0").select(*group, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))
    top = terms.withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", rank).unionByName(top)
