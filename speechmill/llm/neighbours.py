"""Nearest neighbours by a block matrix join: int8 product tiles, error bounds, float recomputation, heaps.

Every row goes into a block of its task and is coded once: codes q of one byte for each component, the scale s, and
the exact length of what the code misses, e = |x - s q|. For a query x and a candidate y

    | x.y  -  s_x s_y (q_x . q_y) |  <=  |s_x q_x| e_y  +  e_x |y|

so a tile (some queries times a block, one matrix product of whole numbers) bounds every inner product from both
sides. A pair survives if its upper bound reaches the query's present k-th score; the survivors alone are recomputed
from the original vectors in double precision, component by component from the left, and go into the query's k best.
Nothing is lost, so recall is 1: a pair that is left out has k better ones.

Plan: one pass packs the blocks into a written table; its query rows and its blocks are replicated to a grid of
(query group, candidate group), one task each, which streams the blocks past the queries. A query has one list of at
most k from each candidate group, and a heap merges these. Query groups bound what a task holds
(``QUERY_GROUP``), candidate groups how long it runs (``CANDIDATE_GROUP``); blocks are shuffled once for each query group.

Equal vectors of a block are multiplied once and listed by their k + 1 smallest ids, as no query can show more of
them; so a vector that a third of all rows share survives once for each block. If a sixteenth of a tile survives
(vectors nearer to each other than codes can tell), a product in double precision bounds it again before pairs are
recomputed, in slices of ``PAIRS``.

Defined cases: vectors that are null or zero or hold null or non-finite components take no part; vectors of
different lengths are never compared; rows are candidates of their own even if ids repeat, and a query row is only
not its own neighbour; a null id is no query and comes last among ties; fewer candidates than k give fewer
rows; an empty table gives none. Other columns take no part.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, finite_vectors, matrix

NEAREST, BLOCK_ROWS, QUERY_ROWS, QUERY_GROUP, CANDIDATE_GROUP, PAIRS = 20, 4096, 1024, 65_536, 4_000_000, 65_536

#: What float32 arithmetic may lose on numbers scaled to lengths of at most 1.
MARGIN = 4e-6
#: Whole numbers up to 127 * 127 * EXACT are exact in float32.
EXACT = 1024

#: A block's distinct vectors, each with the ids and rows of its members (kind 1), or its query rows one by one (kind 0).
BLOCK = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("vectors", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("misses", pa.binary()), ("lengths", pa.binary()),
    ("ids", pa.list_(pa.list_(pa.int64()))), ("rows", pa.list_(pa.list_(pa.int64()))),
])
FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])
NEAR = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def quantized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, lengths of what the codes miss, and lengths, of the rows of ``x``."""
    scale = np.abs(x).max(axis=1) / 127
    with np.errstate(divide="ignore", invalid="ignore"):  # a scale may be too small to divide by: then the codes are 0
        codes = np.nan_to_num(np.rint(x / scale[:, None]), nan=0.0, posinf=127.0, neginf=-127.0).clip(-127, 127)
    return codes.astype(np.int8), scale, np.linalg.norm(x - scale[:, None] * codes, axis=1), np.linalg.norm(x, axis=1)


@dataclass
class Side:
    """Vectors as a tile needs them: in double precision, and coded."""

    x: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    miss: np.ndarray
    length: np.ndarray

    def part(self, lo: int, hi: int) -> Side:
        return Side(self.x[lo:hi], self.codes[lo:hi], self.scale[lo:hi], self.miss[lo:hi], self.length[lo:hi])


def bounds(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, float]:
    """Lower and upper bounds of all products of a's rows and b's, over |a's row| and over the largest length in b.

    |s_x q_x| is at most |x| + e_x.
    """
    most = float(b.length.max())
    near = a.codes @ b.codes.T
    near *= (a.scale / a.length).astype(np.float32)[:, None]
    near *= (b.scale / most).astype(np.float32)[None, :]
    slack = np.outer(((a.length + a.miss) / a.length).astype(np.float32), (b.miss / most).astype(np.float32))
    slack += np.outer((a.miss / a.length).astype(np.float32), (b.length / most).astype(np.float32))
    slack += np.float32(MARGIN)
    return near - slack, near + slack, most


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b`` beside them, summed from the left."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Best:
    """The k best (score, id, row) of each query; an id that is null is ``LAST``, after all others."""

    LAST = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), -np.inf), np.full((n, k), self.LAST), np.full((n, k), -1)

    def add(self, q: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        fit = score >= self.score[q, -1]
        q, score, ident, row = q[fit], score[fit], ident[fit], row[fit]
        if not len(q):
            return
        touched = np.unique(q)
        q = np.concatenate([np.repeat(touched, self.k), q])
        score, ident, row = (np.concatenate([old[touched].ravel(), new]) for old, new in ((self.score, score), (self.id, ident), (self.row, row)))
        order = np.lexsort((row, ident, -score, q))
        first = np.searchsorted(q[order], touched)
        keep = order[(first[:, None] + np.arange(self.k)).ravel()]
        for mine, new in ((self.score, score), (self.id, ident), (self.row, row)):
            mine[touched] = new[keep].reshape(-1, self.k)


def alive(lower: np.ndarray, upper: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Pairs that may belong to a query's k best: ``least`` is its present k-th score, on the scale of the bounds."""
    if np.isneginf(least).any() and lower.shape[1] > k:
        least = np.maximum(least, np.partition(lower, lower.shape[1] - k - 1, axis=1)[:, lower.shape[1] - k - 1])  # one of k + 1 may be the query
    return upper >= least[:, None]


def search_block(queries: Side, own: np.ndarray, block: Side, members: tuple[np.ndarray, np.ndarray, np.ndarray], best: Best) -> None:
    """Adds to ``best`` what a block has for each query. members: ids, rows, and where each vector's begin."""
    ids, rows, starts = members
    for lo in range(0, len(own), QUERY_ROWS):
        part = queries.part(lo, min(lo + QUERY_ROWS, len(own)))
        lower, upper, most = bounds(part, block)
        kth = lambda p=part, at=lo, m=most: best.score[at : at + len(p.x), -1] / (p.length * m)
        left = alive(lower, upper, (kth() - 1e-9).astype(np.float32), best.k)
        if left.mean() > 1 / 16:
            fine = (part.x / part.length[:, None]) @ (block.x / most).T
            room = 1e-14 * (8 + part.x.shape[1])
            left &= alive(fine - room, fine + room, kth() - 1e-12, best.k)
        q, c = np.nonzero(left)
        for at in range(0, len(q), PAIRS):
            qs, cs = q[at : at + PAIRS], c[at : at + PAIRS]
            score = products(part.x[qs], block.x[cs])
            size = starts[cs + 1] - starts[cs]
            one = np.repeat(np.arange(len(qs)), size)
            place = np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size) + starts[cs][one]
            asks = qs[one] + lo
            other = rows[place] != own[asks]
            best.add(asks[other], score[one][other], ids[place][other], rows[place][other])


def _fields(kind: int, block: int, x: np.ndarray, ids: list, rows: list) -> dict:
    codes, scale, miss, length = quantized(x)
    narrow = x.astype(np.float32)
    raw = narrow if (narrow == x).all() else x
    return {"kind": kind, "block": block, "dim": x.shape[1], "n": len(x), "vectors": raw.tobytes(), "codes": codes.tobytes(), "scales": scale.tobytes(), "misses": miss.tobytes(), "lengths": length.tobytes(), "ids": ids, "rows": rows}


def _side(row: dict) -> Side:
    n, dim = row["n"], row["dim"]
    x = np.frombuffer(row["vectors"], np.float32 if len(row["vectors"]) == 4 * n * dim else np.float64).astype(np.float64).reshape(n, dim)
    codes = np.frombuffer(row["codes"], np.int8).reshape(n, dim).astype(np.float32 if dim <= EXACT else np.float64)
    return Side(x, codes, *(np.frombuffer(row[name]) for name in ("scales", "misses", "lengths")))


def _block(rows: pa.RecordBatch, k: int):
    """A block's distinct vectors with their members' k + 1 smallest ids, and its query rows."""
    x, ids, row = matrix(rows.column("embedding")), rows.column("vec_id"), rows.column("row").to_numpy()
    none = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.to_pylist()
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, at, which = np.unique(raw, return_index=True, return_inverse=True)
    which = which.ravel()
    listed_ids, listed_rows = [[] for _ in at], [[] for _ in at]
    for i in np.lexsort((row, ids.fill_null(0).to_numpy(), none)).tolist():
        if len(listed_ids[which[i]]) <= k:
            listed_ids[which[i]].append(number[i])
            listed_rows[which[i]].append(int(row[i]))
    yield _fields(1, int(row[0]), x[at], listed_ids, listed_rows)
    ask = np.flatnonzero(rows.column("ask").to_numpy(zero_copy_only=False))
    if len(ask):
        yield _fields(0, int(row[0]), x[ask], [[number[i]] for i in ask], [[int(row[i])] for i in ask])


def packed(k: int, block_rows: int):
    """A task's rows as blocks of up to ``block_rows`` rows of one length."""

    def whole(parts: list[pa.RecordBatch]):
        for one in pa.Table.from_batches(parts).combine_chunks().to_batches():
            for fields in _block(one, k):
                yield pa.RecordBatch.from_pylist([fields], BLOCK)

    def blocks(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                rest = batch.filter(pa.array(sizes == dim))
                while rest.num_rows:
                    parts = held.setdefault(dim, [])
                    parts.append(rest.slice(0, block_rows - sum(b.num_rows for b in parts)))
                    rest = rest.slice(parts[-1].num_rows)
                    if sum(b.num_rows for b in parts) == block_rows:
                        yield from whole(held.pop(dim))
        for parts in held.values():
            yield from whole(parts)

    return blocks


def searched(k: int):
    """Tiles: a query group's pieces, then the blocks of a candidate group, and so on for each length of vectors."""

    def found(pieces: list[dict], best: Best):
        at = 0
        for piece in pieces:
            rows = []
            for (ident,), (row,) in zip(piece["ids"], piece["rows"], strict=True):
                real = best.row[at] >= 0
                ids = [None if i == Best.LAST else i for i in best.id[at][real].tolist()]
                rows.append({"row": row, "query_id": ident, "scores": best.score[at][real].tolist(), "ids": ids, "rows": best.row[at][real].tolist()})
                at += 1
            yield pa.RecordBatch.from_pylist(rows, FOUND)

    def tiles(batches):
        pieces: list[dict] = []
        queries = best = own = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if best is not None or pieces and pieces[0]["dim"] != row["dim"]:
                        yield from found(pieces, best) if best is not None else ()
                        pieces, best = [], None
                    pieces.append(row)
                    continue
                if not pieces or pieces[0]["dim"] != row["dim"]:
                    continue
                if best is None:
                    sides = [_side(p) for p in pieces]
                    queries = Side(*(np.concatenate([getattr(s, f) for s in sides]) for f in ("x", "codes", "scale", "miss", "length")))
                    pieces = [{"dim": p["dim"], "ids": p["ids"], "rows": p["rows"]} for p in pieces]
                    own = np.array([r for p in pieces for (r,) in p["rows"]])
                    best = Best(len(own), k)
                size = np.array([len(x) for x in row["ids"]])
                flat = [Best.LAST if i is None else i for x in row["ids"] for i in x]
                members = np.array(flat), np.array([r for x in row["rows"] for r in x]), np.concatenate([[0], np.cumsum(size)])
                search_block(queries, own, _side(row), members, best)
        if best is not None:
            yield from found(pieces, best)

    return tiles


def merged(k: int):
    """Each query's lists of the candidate groups, merged by a heap as far as the k-th."""

    def ranked(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lists = [[(-s, i is None, i or 0, r) for s, i, r in zip(x["scores"], x["ids"], x["rows"], strict=True)] for x in row["lists"]]
                for rank, (score, none, ident, _) in enumerate(islice(heapq.merge(*lists), k), 1):
                    out.append({"query_id": row["query_id"], "rank": rank, "vec_id": None if none else ident, "score": -score})
            yield pa.RecordBatch.from_pylist(out, NEAR)

    return ranked


def nearest(vectors: DataFrame, asks: Column, k: int = NEAREST, block_rows: int = BLOCK_ROWS, query_group: int = QUERY_GROUP, candidate_group: int = CANDIDATE_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product for each row where ``asks`` holds."""
    spark = vectors.sparkSession
    rows = finite_vectors(vectors).filter(F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", (F.col("vec_id").isNotNull() & F.coalesce(asks, F.lit(False))).alias("ask"), F.monotonically_increasing_id().alias("row"))
    # Written once: row numbers and blocks would differ if a task that makes them ran again.
    blocks = Scratch(spark, "neighbours").keep(rows.mapInArrow(packed(k, block_rows), from_arrow_schema(BLOCK)), "blocks")
    n = {r.kind: r.n for r in blocks.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    across = max(1, -(-n.get(0, 0) // query_group))
    along = max(1, -(-n.get(1, 0) // candidate_group), min(-(-2 * spark.sparkContext.defaultParallelism // across), -(-n.get(1, 0) // block_rows)))
    mine = lambda parts, seed: F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = blocks.filter("kind = 0").withColumn("_q", mine(across, 1)).withColumn("_c", each(along))
    given = blocks.filter("kind = 1").withColumn("_c", mine(along, 2)).withColumn("_q", each(across))
    tiles = asked.unionByName(given).repartitionById(across * along, F.col("_q") * along + F.col("_c")).sortWithinPartitions("dim", "kind", "block")
    found = tiles.select(*BLOCK.names).mapInArrow(searched(k), from_arrow_schema(FOUND))
    lists = found.groupBy("row", "query_id").agg(F.collect_list(F.struct("scores", "ids", "rows")).alias("lists"))
    return lists.mapInArrow(merged(k), from_arrow_schema(NEAR))
