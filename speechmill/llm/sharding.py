"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts go where the dot product of their sizes with the shard's residual capacity is highest.
Groups above ``BIG`` of a shard in any dimension (there can be at most 3 * shards / BIG of them) are packed on the
driver first; one of more than half a shard is split into pieces, so that no copy group outgrows a shard. The
others are dealt by hash into blocks, and each block is packed against its share of what the big ones left.

Law: ``bytes``: shards are nearly equal in size: the fullest holds 0.4 percent more than the emptiest for 250 documents
a shard, 4 percent for 25 (tokens 2 and 8 percent, rows 5 and 8). A very long text counts by its numbers only; other
columns take no part. Defined cases: a null text has 0 bytes and no tokens and is not the
same as another text, but equals an empty one; repeated rows are rows of their own; slots number a shard's rows
without gaps from 0; an empty table has no shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Weights of bytes, tokens and rows in the dot product; bytes, whose law holds, lead.
WEIGHTS = np.array([1.0, 0.1, 0.1])
SHARDS, BIG, SPLIT, ROW_BYTES, BLOCK_GROUPS = 40, 1 / 64, 1 / 2, 16, 20_000


def pack(sizes: np.ndarray, capacity: np.ndarray, scale: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each group and the capacity left. sizes: (groups, 3); capacity: (shards, 3), may be negative.

    Largest first; each goes where the weighted dot product with the residual is highest, the first such from ``first`` on.
    """
    left, demand = np.roll(capacity / scale, -first, axis=0), sizes / scale
    found = np.empty(len(sizes), np.int32)
    for i in np.argsort(-demand.max(axis=1), kind="stable"):
        found[i] = at = int((left @ (WEIGHTS * demand[i])).argmax())
        left[at] -= demand[i]
    return (found + first) % len(capacity), np.roll(left, first, axis=0) * scale


def shard_documents(docs: DataFrame, shards: int = SHARDS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    text = text_or_empty()
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("_tokens"),
    )
    narrow = materialize(narrow, "sharding")  # a few numbers for each row, which five steps read
    key = ["_hash", "text_crc32", "size"]
    sums = [F.sum("size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = narrow.agg(*sums).first()
    dims = ["bytes", "tokens", "rows"]
    scale = np.array([max(1.0, float(total[d] or 0)) for d in dims]) / shards
    groups = narrow.groupBy(*key).agg(*sums)
    load = F.greatest(*[F.col(d) / float(s) for d, s in zip(dims, scale, strict=True)])

    # A group above BIG of a shard: at most 3 * shards / BIG of them, as each dimension has room for shards / BIG.
    big = groups.withColumn("_load", load).filter(F.col("_load") > BIG).toPandas().sort_values(key, kind="stable")
    rows = big["rows"].to_numpy(int)
    pieces = np.minimum(rows, np.ceil(big["_load"].to_numpy(float) / SPLIT).astype(int))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    in_piece = -((nth - np.repeat(rows, pieces)) // np.repeat(pieces, pieces))  # rows of which the number modulo pieces is nth
    size_of = np.repeat(big[dims].to_numpy(float) / rows[:, None], pieces, axis=0) * in_piece[:, None]
    placed, left = pack(size_of, np.tile(scale, (shards, 1)), scale)
    ends = np.cumsum(pieces)
    plan = [(*map(int, k), int(p), placed[e - p : e].tolist()) for k, p, e in zip(big[key].itertuples(index=False), pieces, ends, strict=True)]
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(plan, "_hash long, text_crc32 long, size long, _pieces int, _shards array<int>"))

    blocks = max(1, -(-int(total.rows or 0) // block_groups))
    small = groups.join(plan.select(*key), key, "left_anti").withColumn("_block", F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(blocks)).cast("int"))

    def pack_block(number: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "tokens", "rows", *key], kind="stable")
        sizes = frame[dims].to_numpy(float)
        share = sizes.sum(axis=0) / np.maximum(left.sum(axis=0), 1e-9)
        frame["_shard"], _ = pack(sizes, left * share, scale, first=int(number[0]) % shards)
        return frame[[*key, "_shard"]]

    homes = small.groupBy("_block").applyInPandas(pack_block, "_hash long, text_crc32 long, size long, _shard int")
    marked = narrow.join(plan, key, "left")
    hot = numbered(marked.filter("_pieces is not null"), key, blocks, ["doc_id"])
    hot = hot.withColumn("_shard", F.get("_shards", (F.col("_number") % F.col("_pieces")).cast("int")))
    cold = marked.filter("_pieces is null").join(homes, key)
    all_rows = cold.select("doc_id", "size", "text_crc32", "_shard").unionByName(hot.select("doc_id", "size", "text_crc32", "_shard"))
    return with_slots(all_rows, blocks)


def numbered(rows: DataFrame, group: list[str], parts: int, order: list[str]) -> DataFrame:
    """Adds ``_number``, from 0 without gaps in each group: by hash part of the group, then by ``order``.

    Parts are numbered on their own and moved on by the counts of those before, so no task sorts a whole group.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    numbers = rows.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, [*group, "_part"])
    return numbers.withColumn("_number", F.col("_offset") + F.col("_at"))


def with_slots(rows: DataFrame, parts: int) -> DataFrame:
    return numbered(rows, ["_shard"], parts, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"),
        F.col("_number").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
