"""Benchmark decontamination by suffix arrays of the training text.

Each task gathers documents into shards of about ``SHARD_WORDS`` words and builds a suffix array over the words of
each shard by prefix doubling; suffixes that cannot hold a benchmark window (a word that no item has comes too soon)
are left out. Every suffix of every item is binary-searched in it by its window, and the matches are followed to
their full verbatim length. Documents are not shuffled; an answer is part of its document's row.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES``; a larger one takes several passes, each of which
adds to what the passes before have found.

A window is ``WINDOW`` consecutive words of an item, or all of a shorter one. Defined cases: null or wordless texts
have no words and no windows; rows are documents of their own even if doc_ids repeat; an item without id is named "".
An empty table gives no rows, an empty benchmark no hits; a very long text is one shard of its own; findings take
names that the carried columns must not have (``fresh`` gives such). Where an item holds a window several times, a
match names one of its places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, slices, text_or_empty, utf8_values

WINDOW, SHARD_WORDS, BLOCK_BYTES = 10, 250_000, 4_000_000

#: ASCII letters and digits and all bytes of other characters are parts of words; A-Z count as a-z.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("length", T.LongType())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class _Known(dict):
    def __missing__(self, word):
        return 0


class Benchmark:
    """Items as numbers of words, and their distinct windows with the places where they occur."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.known, self.names, self.words = _Known(), [], []
        places: dict[bytes, dict[int, dict[int, None]]] = {}  # window -> item -> its starts there, in order
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.known.setdefault(w, len(self.known) + 1) for w in words], np.int64)
            for at in range(max(1, len(ids) - window + 1)):
                places.setdefault(ids[at : at + window].tobytes(), {}).setdefault(len(self.names), {})[at] = None
            self.names.append(name)
            self.words.append(ids)
        self.windows = [np.frombuffer(w, np.int64) for w in places]
        self.places = list(places.values())
        self.least = min(map(len, self.windows), default=0)
        self.depth = max(map(len, self.words), default=0)


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes by up to ``depth`` words; a 0 ends a suffix. Prefix doubling.

    A start is compared with what follows it only through ranks of other starts, so each start that is needed is kept
    until a 0: ``text`` must have ranks of single words wherever a suffix can reach.
    """
    rank, step = text.copy(), 1
    inside = np.flatnonzero(text)
    while step < depth:
        ahead = np.zeros(len(inside), np.int64)
        reach = inside + step
        fits = reach < len(text)
        ahead[fits] = rank[reach[fits]]
        key = rank[inside] * (int(rank.max()) + 1) + ahead
        values, new = np.unique(key, return_inverse=True)
        unchanged = len(values) == len(np.unique(rank[inside]))
        rank = np.zeros_like(rank)
        rank[inside] = new + 1
        step *= 2
        if unchanged:
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def _bounds(text: np.ndarray, suffixes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted`` (0: no more words), the suffixes that begin with it are those from lo up to hi."""
    width = wanted.shape[1]
    offsets = np.arange(width)
    used = wanted > 0

    def search(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(suffixes), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            have = text[suffixes[np.minimum(mid, len(suffixes) - 1)][:, None] + offsets]
            differs = (have != wanted) & used
            first = differs.argmax(axis=1)
            some = differs.any(axis=1)
            rows = np.arange(len(wanted))
            less = np.where(some, have[rows, first] < wanted[rows, first], after)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    return search(False), search(True)


def _matches(index: Benchmark, texts: list[bytes]) -> tuple[list[int], list[np.ndarray], list[list[tuple]]]:
    """Words, hit words (as a mask) and longest matches of each text of one shard."""
    counts, parts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter(map(index.known.__getitem__, words), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
    width = max([len(w) for w in index.windows], default=0)
    shard = np.concatenate([*parts, np.zeros(width + 1, np.int64)])
    begin = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])[: len(counts)]
    hit = np.zeros(len(shard), bool)
    found: list[list[tuple]] = [[] for _ in texts]
    if index.windows:
        ends = np.flatnonzero(shard == 0)
        inside = np.flatnonzero(shard)
        run = ends[np.searchsorted(ends, inside)] - inside
        long = run >= index.least
        kept = np.zeros_like(shard)  # words in runs that are long enough, as only they can be part of a match
        alive = inside[long]
        if len(alive):
            cover = np.zeros(len(shard) + 1, np.int64)
            np.add.at(cover, alive, 1)
            np.add.at(cover, alive + index.least, -1)
            kept = np.where(np.cumsum(cover[:-1]) > 0, shard, 0)
            suffixes = suffix_array(kept, alive, index.depth)
            wanted = np.zeros((len(index.windows), width), np.int64)
            for i, w in enumerate(index.windows):
                wanted[i, : len(w)] = w
            lo, hi = _bounds(kept, suffixes, wanted)
            for i in np.flatnonzero(lo < hi):
                size = len(index.windows[i])
                at = suffixes[lo[i] : hi[i]]
                for k in range(size):
                    hit[at + k] = True
                owner = np.searchsorted(begin, at, side="right") - 1
                for p, d in zip(at.tolist(), owner.tolist(), strict=True):
                    found[d].append((p - int(begin[d]), int(i)))
    masks = [hit[b : b + n] for b, n in zip(begin.tolist(), counts, strict=True)]
    return counts, masks, [_longest(index, f) for f in found]


def _longest(index: Benchmark, found: list[tuple[int, int]]) -> list[tuple]:
    """Verbatim matches (item, word, item word, length), from the windows found at words.

    Left to right, a window goes on with an item's match if it also stands at the next word of the item; else a new
    match begins at the item's first such place. So each window found adds one step for each item that has it.
    """
    out: list[tuple] = []
    open_at: dict[int, list[int]] = {}  # item -> word, item word, length, last window's word
    for word, i in sorted(found):
        size = len(index.windows[i])
        for item, starts in index.places[i].items():
            now = open_at.get(item)
            if now is not None and now[3] == word - 1 and now[1] + word - now[0] in starts:
                now[2:] = word + size - now[0], word
                continue
            if now is not None:
                out.append((index.names[item], *now[:3]))
            open_at[item] = [word, next(iter(starts)), size, word]
    out += [(index.names[item], *now[:3]) for item, now in open_at.items()]
    return sorted(out)


def _pass(source: DataFrame, items, body: str, state: list[str], window: int, shard_words: int) -> DataFrame:
    """Adds one block's findings to the columns ``state``: words, mask of hit words, matches."""

    def searched(batches):
        index = Benchmark([(n, t.encode()) for n, t in items.value], window)

        def shard(pieces: list[pa.RecordBatch]):
            if not pieces:
                return
            table = pa.Table.from_batches(pieces).combine_chunks()
            counts, masks, found = _matches(index, utf8_values(table.column(body)))
            for i, (mask, rest) in enumerate(zip(table.column(state[1]).to_pylist(), table.column(state[2]).to_pylist(), strict=True)):
                if mask is not None:
                    masks[i] = masks[i] | np.unpackbits(np.frombuffer(mask, np.uint8), count=counts[i]).astype(bool)
                    found[i] = [*(tuple(x.values()) for x in rest or []), *found[i]]
            hits = [int(m.sum()) for m in masks]
            new = [pa.array(counts, pa.int64()), pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()), pa.array([[dict(zip(("item", "word", "item_word", "length"), f, strict=True)) for f in x] for x in found], table.schema.field(state[2]).type), pa.array(hits, pa.int64())]
            yield from pa.table([*table.columns[:-4], *new], names=table.column_names).to_batches()

        held, size = [], 0
        for batch in slices(batches, 200):
            held.append(batch)
            size += batch.column(body).nbytes // 6
            if size >= shard_words:
                yield from shard(held)
                held, size = [], 0
        yield from shard(held)

    return source.mapInArrow(searched, source.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str], names: tuple[str, str, str] = ("n_words", "n_hit", "matches"), window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``carry`` of every document, and under ``names`` its words, its hit words and its matches (item, word, item_word, length)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), text_or_empty().alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = total // block_bytes + 1
    body, mask = fresh(docs, "body"), fresh(docs, "mask")
    empty = dict(zip((names[0], mask, names[2], names[1]), (T.LongType(), T.BinaryType(), FOUND, T.LongType()), strict=True))
    source = docs.select(*[F.col(f"`{c}`") for c in carry], text_or_empty().alias(body), *[F.lit(None).cast(k).alias(n) for n, k in empty.items()])
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        if block:
            source = materialize(source, "decontam-pass")
        given = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.orderBy("name", "text").collect()])
        source = _pass(source, given, body, [names[0], mask, names[2]], window, shard_words)
    return source.select(*[F.col(f"`{c}`") for c in carry], *[F.col(f"`{n}`") for n in names])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least_hit: int = 1) -> DataFrame:
    """The documents of which fewer than ``least_hit`` words lie in benchmark windows."""
    names = (fresh(docs, "n_words"), fresh(docs, "n_hit"), fresh(docs, "matches"))
    found = find_contamination(docs, benchmark, docs.columns, names)
    return found.filter(F.col(names[1]) < least_hit).select(*[F.col(f"`{c}`") for c in docs.columns])
