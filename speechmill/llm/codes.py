"""Vector code compression: product codes by Lloyd rounds in whole numbers, with Hamerly's bounds.

Each component x counts as floor(1024 x). A vector is cut into four equal parts; the codebook of a part position
starts as that part of the 256 smallest ids. A round assigns each part to the nearest entry and moves each entry to
its parts' floored mean; after the last round the parts are assigned once more.

A part keeps two bounds from round to round: ``upper`` on the distance to its entry and ``lower`` on the distance to
the second-nearest one. When entries move, ``upper`` grows by its own entry's way and ``lower`` shrinks by the longest
way of any other. While ``upper`` is strictly below ``lower``, or below half the way from its entry to the nearest
other one, no other entry is as near and the part is left alone; else ``upper`` is made exact and compared again, and
only then all entries are scanned, in whole numbers, the lowest index first among ties. Bounds are rounded away from
the truth, so they never hide a tie.

Plan: vectors never move. A task packs them into blocks with their codes and bounds and writes these; each round reads
the blocks before and writes new ones, together with what the round's changed codes add to and take from the entries'
sums. Only these sums (at most 4 * 256 * (part length + 1) numbers after Spark has added them up) reach the
driver, and only the codebooks go out to the tasks. Label sums are joined back to salted rows.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; of the rest, all vectors
that are as long as the smallest id's are coded, if that length is a multiple of four; the others, and those with a
component of 2**17 or more in size (their squares leave 64 bits), stay with a null code and error, and no sum counts
them. Null ids come last, equal ids by their vectors; repeated rows are rows of their own; fewer than 256 rows make
fewer entries; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import Scratch, finite_vectors, matrix

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK_ROWS, SALTS = 4, 256, 4, 1024, 4096, 32
LARGEST = 2**17

SUMS = pa.schema([("entry", pa.int32()), ("component", pa.int32()), ("value", pa.int64())])


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, exact: in float64 while all terms are below 2**53, else in int64."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


class Codebook:
    """The entries of one part position, and how far they moved since the round before."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.way = above(np.sqrt(((entries - before) ** 2).sum(1))) if before is not None else np.zeros(len(entries))
        top = int(self.way.argmax()) if len(entries) else 0
        other = np.delete(self.way, top).max(initial=0.0)
        self.others = np.full(len(entries), self.way.max(initial=0.0))  # the longest way of any entry but the own
        if len(entries):
            self.others[top] = other
        apart = distances(entries, entries).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = below(np.sqrt(apart.min(axis=1, initial=np.inf)) / 2)

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New codes and bounds of the parts ``x``, and how many were scanned; a code below 0 is none yet."""
        code, upper, lower = code.copy(), above(upper + self.way[code]), below(lower - self.others[code])
        fresh = code < 0
        open_ = np.flatnonzero(fresh | ~(upper < np.maximum(lower, self.half[code])))
        known = open_[~fresh[open_]]
        upper[known] = above(np.sqrt(((x[known] - self.entries[code[known]]) ** 2).sum(1)))
        open_ = open_[fresh[open_] | ~(upper[open_] < np.maximum(lower[open_], self.half[code[open_]]))]
        for at in range(0, len(open_), 8192):
            rows = open_[at : at + 8192]
            d = distances(x[rows], self.entries)
            code[rows] = d.argmin(axis=1)  # the first of equal ones
            upper[rows] = above(np.sqrt(d[np.arange(len(rows)), code[rows]]))
            lower[rows] = below(np.sqrt(np.partition(d, 1, axis=1)[:, 1])) if d.shape[1] > 1 else np.inf
        return code, upper, lower, len(open_)


def changes(x: np.ndarray, old: np.ndarray, new: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that gained or lost parts; for each the change of its sums and, behind them, of its count."""
    moved = np.flatnonzero(old != new)
    sums = np.zeros((n, x.shape[1] + 1), np.int64)
    gained = np.concatenate([x[moved], np.ones((len(moved), 1), np.int64)], axis=1)
    had = moved[old[moved] >= 0]
    np.add.at(sums, new[moved], gained)
    np.subtract.at(sums, old[had], np.concatenate([x[had], np.ones((len(had), 1), np.int64)], axis=1))
    touched = np.unique(np.concatenate([new[moved], old[had]]))
    return touched, sums[touched]


class _Blocks:
    """Blocks of vectors with their codes and bounds, as rows of a written table."""

    def __init__(self, dim: int, label: pa.DataType, size: int):
        self.dim, self.width, self.size = dim, dim // PARTS, size
        self.schema = pa.schema([
            ("ids", pa.list_(pa.int64())), ("labels", pa.list_(label)), ("vectors", pa.binary()), ("codes", pa.binary()), ("uppers", pa.binary()), ("lowers", pa.binary()),
            ("entries", pa.binary()), ("sums", pa.binary()), ("scanned", pa.int64()),
        ])

    def first(self, books):
        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    rows = batch.slice(at, BLOCK_ROWS)
                    x = np.floor(matrix(rows.column("embedding")) * SCALE).astype(np.int32)
                    none = np.full((len(x), PARTS), -1, np.int64), np.zeros((len(x), PARTS)), np.zeros((len(x), PARTS))
                    yield self._step(rows.column("vec_id"), rows.column("label"), x, none, books.value)

        return pack

    def next(self, books):
        def step(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    ids, labels = row.column("ids").flatten(), row.column("labels").flatten()
                    yield self._step(ids, labels, *self._state(row), books.value)

        return step

    def _state(self, row: pa.RecordBatch):
        raw = lambda name, kind: np.frombuffer(row.column(name)[0].as_py(), kind)
        x = raw("vectors", np.int32).reshape(-1, self.dim)
        return x, (raw("codes", np.uint8).astype(np.int64).reshape(-1, PARTS), raw("uppers", np.float64).reshape(-1, PARTS), raw("lowers", np.float64).reshape(-1, PARTS))

    def _step(self, ids, labels, x: np.ndarray, state, books: list[Codebook]) -> pa.RecordBatch:
        codes, uppers, lowers = (s.copy() for s in state)
        entries, sums, scanned = [], [], 0
        for p, book in enumerate(books):
            part = x[:, p * self.width : (p + 1) * self.width].astype(np.int64)
            old = codes[:, p].copy()
            codes[:, p], uppers[:, p], lowers[:, p], n = book.assign(part, old, uppers[:, p], lowers[:, p])
            touched, change = changes(part, old, codes[:, p], len(book.entries))
            entries.append(touched + p * self.size)
            sums.append(change)
            scanned += n
        values = [ids.to_pylist(), labels.to_pylist(), x.tobytes(), codes.astype(np.uint8).tobytes(), uppers.tobytes(), lowers.tobytes(), np.concatenate(entries).astype(np.int32).tobytes(), np.concatenate(sums).tobytes(), scanned]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, self.schema, strict=True)], schema=self.schema)

    def sums(self, batches):
        """A task's changes, one row for each number."""
        total = np.zeros((PARTS * self.size, self.width + 1), np.int64)
        for batch in batches:
            for entries, sums in zip(batch.column("entries").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(entries, np.int32), np.frombuffer(sums, np.int64).reshape(-1, self.width + 1))
        entry, component = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int32()), pa.array(component, pa.int32()), pa.array(total[entry, component])], schema=SUMS)

    def coded(self, books):
        """vec_id, label, code and error of each vector, by the codes of the blocks."""
        schema = pa.schema([("vec_id", pa.int64()), ("label", self.schema.field("labels").type.value_type), ("code", pa.string()), ("error", pa.int64())])

        def rows(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    x, (codes, _, _) = self._state(row)
                    error = np.zeros(len(x), np.int64)
                    for p, book in enumerate(books.value):
                        error += ((x[:, p * self.width : (p + 1) * self.width].astype(np.int64) - book.entries[codes[:, p]]) ** 2).sum(1)
                    text = codes.astype(np.uint8).tobytes().hex()
                    code = [text[at : at + 2 * PARTS] for at in range(0, len(text), 2 * PARTS)]
                    yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), pa.array(code, pa.string()), pa.array(error)], schema=schema)

        return rows, schema


def compress(vectors: DataFrame, label: str = "label", rounds: int = ROUNDS, size: int = ENTRIES, salts: int = SALTS, told: list | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector. ``size``: entries of a codebook, 256 at most. ``told`` gets the parts scanned in each assignment."""
    spark = vectors.sparkSession
    kept = finite_vectors(vectors).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col(label).alias("label"))
    order = [F.asc_nulls_last("vec_id"), F.asc("embedding")]
    smallest = kept.orderBy(*order).select(F.size("embedding").alias("dim")).limit(1).collect()
    dim = smallest[0].dim if smallest else 0
    usable = (F.size("embedding") == dim) & F.lit(dim > 0 and dim % PARTS == 0) & F.forall("embedding", lambda x: F.abs(x) < LARGEST)
    good, rest = kept.filter(usable), kept.filter(~usable)
    start = [r.embedding for r in good.orderBy(*order).limit(size).collect()]
    sha = hashlib.sha256()
    kind = from_arrow_schema(SUMS)
    if start:
        width = dim // PARTS
        first = np.floor(np.array(start, np.float64) * SCALE).astype(np.int64)
        entries = [first[:, p * width : (p + 1) * width] for p in range(PARTS)]
        blocks = _Blocks(dim, to_arrow_type(kept.schema["label"].dataType), size)
        books = spark.sparkContext.broadcast([Codebook(e) for e in entries])  # at most 256 vectors
        scratch = Scratch(spark, "codes")
        table = scratch.keep(good.mapInArrow(blocks.first(books), from_arrow_schema(blocks.schema)), "assigned-0")
        total = np.zeros((PARTS * size, width + 1), np.int64)
        for n in range(rounds):
            change = table.select("entries", "sums").mapInArrow(blocks.sums, kind).groupBy("entry", "component").agg(F.sum("value").alias("value"))
            for r in change.collect():
                total[r.entry, r.component] += r.value
            after = []
            for p, old in enumerate(entries):
                sums = total[p * size : p * size + len(old)]
                used = sums[:, -1:] > 0
                after.append(np.where(used, sums[:, :-1] // np.maximum(sums[:, -1:], 1), old))
            books = spark.sparkContext.broadcast([Codebook(e, old) for e, old in zip(after, entries, strict=True)])
            entries = after
            table = scratch.keep(table.mapInArrow(blocks.next(books), from_arrow_schema(blocks.schema)), f"assigned-{n + 1}")
            if told is not None:
                told.append(table.agg(F.sum("scanned")).first()[0])
            scratch.drop(f"assigned-{n}")
        sha.update(",".join(str(x) for e in entries for x in e.ravel().tolist()).encode())
        rows, schema = blocks.coded(books)
        done = table.mapInArrow(rows, from_arrow_schema(schema))
        done = done.unionByName(rest.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")))
    else:
        done = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    # A label that a third of all rows share is dealt over the salts; its sum is one row for each of them.
    sums = done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = done.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    same = F.col("a._salt").eqNullSafe(F.col("b._salt")) & F.col("a.label").eqNullSafe(F.col("b.label"))
    joined = dealt.alias("a").join(sums.alias("b"), same)
    return joined.select("a.vec_id", "a.code", "a.error", "b.label_error", F.lit(sha.hexdigest()).alias("codebooks_sha256"))
