"""LM scoring with a weighted backoff automaton over words, pairs and triples counted over the whole training part.

Documents are packed into chunks of about ``chunk_bytes``: distinct words' hashes and the tokens as numbers. A chunk
asks, once per distinct word and pair, for its training count; requests go to buckets by hash, so a word that makes
up a third of all tokens is one row per chunk. A bucket sums what the chunks counted and answers each of them in the
order of its request, which depends on the keys alone. With the pairs' counts a chunk knows which histories of two
words have a state, and asks likewise for the triples after these. A pair seen once is known to the one chunk that counted it, which
adds it to the size class of its first word's whole count; a triple's key holds the class of its history. With these
sums a chunk builds the part of the automaton that its documents can reach and traverses them.

The model: state "uv" stands for two words that were seen together ``STATE_COUNT`` times or more, state "v" for one
word that was seen at all. A state has an arc for each word w seen after it and a failure arc: from "uv" to "v", from
"v" to the root, which has an arc for each known word and one for all unknown words.
    root:  p(w) = (c(w) - d) / N,  p(unknown) = d V / N,  d from the counts of words seen once and twice
    v:     p(w | v) = (1 - g) c(v,w) / c(v) + g p(w);  failure arc: g
    uv:    p(w | u,v) = (1 - h) c(u,v,w) / c(u,v) + h p(w | v);  failure arc: h
    g and h, by the size class of c(v) or c(u,v) over all training data, are the share of tokens after such a history
    whose pair or triple is seen once.
Every state's probabilities sum to 1. A text begins at a state of its own; the pair of it and a word is a history too.

Memory: one chunk or one bucket in a task; both numbers grow with the text. Only a few sums for each size class are
broadcast. Pairs are told apart by 40 bits of their hash and the bucket they are in, triples by 43, their history's
size class and the bucket; words by 64 bits. A very long text is a chunk of its own size.

Defined cases: a null text counts as empty and is one end token; repeated rows count each; a null doc_id is never
held out, as its remainder is null; an empty training part gives every token probability 1; an empty table gives no
rows; other columns of ``docs`` are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices, text_or_empty, total_bytes, utf8_values

CHUNK_BYTES, BUCKET_BYTES = 7_000_000, 10_000_000
ROWS_AT_ONCE = 500
CLASSES = 32
STATE_COUNT = 2
END = b""
START_HASH = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
PAIR_BITS = np.uint64((1 << 40) - 1)
TRIPLE_BITS = np.uint64((1 << 43) - 1)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)

#: Kinds of requests and the bytes of their keys; a row of kind SUMS carries what the chunk itself knows of histories.
WORDS, PAIRS, TRIPLES, SUMS = 0, 1, 2, -1
WIDTH = {WORDS: 8, PAIRS: 5, TRIPLES: 6}

CHUNKS = "chunk long, doc_ids array<long>, held_out array<boolean>, sizes binary, words binary, tokens binary"
REQUESTS = "bucket int, chunk long, kind int, n long, keys binary, counts binary"
ANSWERS = "chunk long, bucket int, kind int, n long, counts binary, stats array<double>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Ids(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def _encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number of each token, tokens of each text, hash of each word number. Word 0 is the end."""
    ids = _Ids()
    ids[END]  # noqa: B018
    parts, sizes = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        words.append(END)
        parts.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
        sizes.append(len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(sizes, np.int64), hashes


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _pack(chunk_bytes: int):
    """Texts as chunks of word numbers. A chunk's number is that of its partition and its place there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, held, texts = [], [], []
        for batch in slices(batches, ROWS_AT_ONCE):
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), utf8_values(batch.column("text")), strict=True):
                for into, value in zip((ids, held, texts), row, strict=True):
                    into.append(value)
                size += len(row[2]) + 1
                if size >= chunk_bytes:
                    yield _chunk_row(number, ids, held, texts)
                    number, size = number + 1, 0
                    ids, held, texts = [], [], []
        if ids:
            yield _chunk_row(number, ids, held, texts)

    return pack


def _chunk_row(number: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
    tokens, sizes, words = _encoded(texts)
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return _batch(CHUNKS, [(number, ids, held, sizes.tobytes(), words.tobytes(), zstandard.ZstdCompressor(level=1).compress(planes))])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _MIX) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(30))


class Chunk:
    """Distinct words and pairs of some texts, in the order that requests and answers share."""

    def __init__(self, row: dict, buckets: int):
        self.buckets = np.uint64(buckets)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.uint8)
        self.tokens = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.trains = np.repeat(~np.array(row["held_out"], bool), self.sizes)
        self.word = word_hash = np.frombuffer(row["words"], np.uint64)
        before = np.empty(len(self.tokens), np.int64)  # word numbers moved up by one; 0: the start of a text
        before[1:] = self.tokens[:-1].astype(np.int64) + 1
        before[self.starts] = 0
        self.before = before
        word_bucket = word_hash % self.buckets
        self.word_order = np.lexsort((word_hash, word_bucket))
        self.word_hash, self.word_bucket = word_hash[self.word_order], word_bucket[self.word_order]
        self.distinct, self.pair_at = np.unique(before.astype(np.uint64) << _HALF | self.tokens, return_inverse=True)
        from_hash = np.concatenate([[START_HASH], word_hash])[(self.distinct >> _HALF).astype(np.int64)]
        self.pair = key = _mixed(from_hash, word_hash[(self.distinct & _LOW).astype(np.int64)])
        pair_bucket = (key >> np.uint64(40)) % self.buckets
        self.pair_order = np.argsort(pair_bucket << np.uint64(40) | key & PAIR_BITS, kind="stable")
        self.pair_key, self.pair_bucket = (key & PAIR_BITS)[self.pair_order], pair_bucket[self.pair_order]
        self.own_pairs = np.bincount(self.pair_at[self.trains], minlength=len(self.distinct))

    def requests(self) -> Iterator[tuple]:
        words = np.bincount(self.tokens[self.trains], minlength=len(self.word))
        yield from _asked(WORDS, self.word_bucket, self.word_hash, words[self.word_order])
        yield from _asked(PAIRS, self.pair_bucket, self.pair_key, self.own_pairs[self.pair_order])

    def answered(self, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all words and all pairs over the whole training part."""
        words, pairs = np.zeros(len(self.word), np.int64), np.zeros(len(self.distinct), np.int64)
        words[self.word_order], pairs[self.pair_order] = _told(WORDS, replies), _told(PAIRS, replies)
        return words, pairs


class Triples:
    """Distinct triples of a chunk's texts whose first two words have a state and whose last two were seen."""

    def __init__(self, chunk: Chunk, c_pair: np.ndarray, order: int):
        history = np.empty(len(chunk.tokens), np.int64)
        history[1:] = chunk.pair_at[:-1]
        history[chunk.starts] = -1
        self.c_history = np.where(history >= 0, c_pair[history], 0)
        self.has_state = (self.c_history >= STATE_COUNT) & (order > 2)
        self.at = np.flatnonzero(self.has_state & (c_pair[chunk.pair_at] > 0))
        distinct, self.triple_at = np.unique(history[self.at].astype(np.uint64) << _HALF | chunk.tokens[self.at], return_inverse=True)
        own = np.bincount(self.triple_at[chunk.trains[self.at]], minlength=len(distinct))
        first = (distinct >> _HALF).astype(np.int64)
        mixed = _mixed(chunk.pair[first], chunk.word[(distinct & _LOW).astype(np.int64)])
        key = _size_class(c_pair[first]).astype(np.uint64) << np.uint64(43) | mixed & TRIPLE_BITS
        bucket = _mixed(mixed, START_HASH) % chunk.buckets
        self.order = np.lexsort((key, bucket))
        self.key, self.bucket, self.own = key[self.order], bucket[self.order], own[self.order]

    def requests(self) -> Iterator[tuple]:
        yield from _asked(TRIPLES, self.bucket, self.key, self.own)

    def answered(self, replies: list[dict]) -> np.ndarray:
        counts = np.zeros(len(self.order), np.int64)
        counts[self.order] = _told(TRIPLES, replies)
        return counts


def _asked(kind: int, bucket: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    for b, lo, hi in _runs(bucket):
        yield b, kind, hi - lo, _packed(key[lo:hi], WIDTH[kind]), _narrow(count[lo:hi])


def _told(kind: int, replies: list[dict]) -> np.ndarray:
    parts = [_wide(r["counts"]) for r in sorted(replies, key=lambda r: r["bucket"]) if r["kind"] == kind]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _histories(c_word: np.ndarray) -> np.ndarray:
    """How often the start and each word are followed by another; the start is as often as the end is seen."""
    return np.concatenate([c_word[:1], c_word])


def _size_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.uint8), CLASSES - 1)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_values):
        cuts = np.flatnonzero(np.diff(sorted_values)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(sorted_values)], strict=True):
            yield int(sorted_values[lo]), int(lo), int(hi)


def _packed(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted keys, all first bytes before all second ones, so that the high ones compress."""
    return np.ascontiguousarray(np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest; the first byte says how many."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(counts) or counts.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"u{data[0]}"), offset=1).astype(np.int64)


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            asked = list(Chunk(row, buckets).requests())
            yield _batch(REQUESTS, [(b, row["chunk"], *rest) for b, *rest in asked])

    return ask


def _ask_triples(buckets: int, order: int):
    """Requests for triples, and one row of what the chunk knows: its pairs seen once in all and its tokens after two
    words, by the size class of the history."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, buckets)
            words, pairs = chunk.answered(row["replies"])
            triples = Triples(chunk, pairs, order)
            once = (chunk.distinct[(chunk.own_pairs == 1) & (pairs == 1)] >> _HALF).astype(np.int64)
            known = [
                _size_class(_histories(words)[once]),
                _size_class(triples.c_history[triples.has_state & chunk.trains]),
            ]
            sums = np.concatenate([np.bincount(x, minlength=CLASSES) for x in known]).astype(np.float64)
            asked = [(b, row["chunk"], *rest) for b, *rest in triples.requests()]
            yield _batch(REQUESTS, [*asked, (row["chunk"] % buckets, row["chunk"], SUMS, 0, b"", sums.tobytes())])

    return ask


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _answer(table: pa.Table) -> pa.Table:
    """Sums one bucket's requests, answers each of them, and adds one row of statistics (chunk -1)."""
    out = []
    bucket = table.column("bucket")[0].as_py()
    stats = np.zeros((5, CLASSES))
    for kind in (WORDS, PAIRS, TRIPLES):
        part = table.filter(pc.equal(table.column("kind"), kind))
        if not part.num_rows:
            continue
        part = part.sort_by("chunk")
        keys = np.concatenate([_unpacked(x, WIDTH[kind]) for x in part.column("keys").to_pylist()])
        counts = np.concatenate([_wide(x) for x in part.column("counts").to_pylist()])
        distinct, at = np.unique(keys, return_inverse=True)
        del keys
        total = np.bincount(at, weights=counts).astype(np.int64)
        if kind == WORDS:
            stats[0, :4] = total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()
            stats[1] = np.bincount(_size_class(total), weights=total, minlength=CLASSES)  # the end's count stands for the start's
        if kind == TRIPLES:
            stats[4] = np.bincount((distinct[total == 1] >> np.uint64(43)).astype(np.int64), minlength=CLASSES)
        found, lo = total[at], 0
        for number, n in zip(part.column("chunk").to_pylist(), part.column("n").to_pylist(), strict=True):
            out.append((number, bucket, kind, n, _narrow(found[lo : lo + n]), None))
            lo += n
    for known in table.filter(pc.equal(table.column("kind"), SUMS)).column("counts").to_pylist():
        stats[2:4] += np.frombuffer(known).reshape(2, CLASSES)
    out.append((-1, bucket, SUMS, 0, b"", stats.ravel().tolist()))
    return pa.Table.from_batches([_batch(ANSWERS, out)])


class Automaton:
    """States with weighted arcs, as arrays: root arcs by word, arcs of one-word states by pair, of two-word states by
    triple, failure weights by state."""

    def __init__(self, chunk: Chunk, triples: Triples, c_word: np.ndarray, c_pair: np.ndarray, c_triple: np.ndarray, stats: np.ndarray):
        sums, after_one, once_one, after_two, once_two = stats.reshape(5, CLASSES)
        self.n, self.v, once, twice = sums[:4]
        if self.n:
            d = min(max((once + 1) / (once + 2 * twice + 2), 0.05), 0.95)
            root = np.where(c_word > 0, (c_word - d) / self.n, d * self.v / self.n)
        else:
            root = np.ones(len(c_word))
        c_from = _histories(c_word)
        g = np.where(c_from > 0, ((once_one + 1) / (after_one + 2))[_size_class(c_from)], 1.0)
        at_from, at_word = (chunk.distinct >> _HALF).astype(np.int64), (chunk.distinct & _LOW).astype(np.int64)
        one = (1 - g[at_from]) * c_pair / np.maximum(c_from[at_from], 1) + g[at_from] * root[at_word]
        h = ((once_two + 1) / (after_two + 2))[_size_class(triples.c_history)]
        two, seen = np.ones(len(chunk.tokens)), np.zeros(len(chunk.tokens), bool)
        at, count = triples.at, c_triple[triples.triple_at]
        two[at] = (1 - h[at]) * count / np.maximum(triples.c_history[at], 1) + h[at] * one[chunk.pair_at[at]]
        seen[at] = count > 0
        # Two words, one word, none: has this history a state, has the state an arc for the token, the arc's and the failure's weight.
        self.levels = [
            (triples.has_state, seen, np.log10(two), np.log10(h)),
            ((c_from > 0)[chunk.before], (c_pair > 0)[chunk.pair_at], np.log10(one)[chunk.pair_at], np.log10(g)[chunk.before]),
            (np.ones(len(chunk.tokens), bool), np.ones(len(chunk.tokens), bool), np.log10(root)[chunk.tokens], np.zeros(len(chunk.tokens))),
        ]

    def traverse(self) -> np.ndarray:
        """Log-probability of each token: from the state of the longest history along failure arcs to the first arc."""
        score, waits = np.zeros(len(self.levels[0][0])), np.ones(len(self.levels[0][0]), bool)
        for has_state, has_arc, arc, failure in self.levels:
            here = waits & has_state
            score += np.where(here, np.where(has_arc, arc, failure), 0.0)
            waits &= ~(here & has_arc)
        return score


def _score(buckets: int, order: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, buckets)
            words, pairs = chunk.answered(row["replies"])
            triples = Triples(chunk, pairs, order)
            stats = np.array(row["stats"]) + np.array(row["more_stats"])
            model = Automaton(chunk, triples, words, pairs, triples.answered(row["more_replies"] or []), stats)
            base = np.log10((words + 0.1) / (model.n + 0.1 * (model.v + 1)))
            by_text = lambda x: np.add.reduceat(x, chunk.starts)
            columns = {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(row["held_out"], pa.bool_()),
                "n_tokens": pa.array(chunk.sizes, pa.int64()),
                "n_known": pa.array(by_text((words[chunk.tokens] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(chunk.sizes), int(model.n)), pa.int64()),
                "base_score": pa.array(by_text(base[chunk.tokens])),
                "score": pa.array(by_text(model.traverse())),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return score


def score_documents(docs: DataFrame, held_out_mod: int = 10, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, order: int = 3, scanned: bool = False) -> DataFrame:
    """Scores of all documents under a model of those whose crc32(doc_id) mod ``held_out_mod`` is not 0.

    ``order`` 2 leaves out the states of two words. A chunk is what one input partition holds in its order, and answers
    fit that order; so rows are sorted in their partitions, unless ``docs`` is a plain scan of files (``scanned``), which
    a task that runs again reads in the same order.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    if not scanned:
        docs = docs.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_mod == 0, F.lit(False))
    rows, size = total_bytes(docs)
    tasks, buckets = 1 + (size + rows) // chunk_bytes, 1 + (size + rows) // bucket_bytes
    packed = docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_pack(chunk_bytes), CHUNKS).repartition(tasks, "chunk")

    def told(asked: DataFrame, replies: str, stats: str) -> tuple[DataFrame, DataFrame]:
        """The answers of each chunk, dealt as the chunks are, and the sums of all buckets."""
        answered = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWERS)
        sums = answered.filter("chunk = -1").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(5 * CLASSES)]).alias(stats))
        each = answered.filter("chunk >= 0").select("chunk", F.struct("bucket", "kind", "counts").alias("reply")).repartition(tasks, "chunk")
        return each.groupBy("chunk").agg(F.collect_list("reply").alias(replies)), sums

    first, sums = told(packed.mapInArrow(_ask(buckets), REQUESTS), "replies", "stats")
    with_pairs = packed.join(first, "chunk", "left")  # an inner join would filter the chunks anew and shuffle them twice
    second, more_sums = told(with_pairs.mapInArrow(_ask_triples(buckets, order), REQUESTS), "more_replies", "more_stats")
    known = with_pairs.join(second, "chunk", "left").join(F.broadcast(sums)).join(F.broadcast(more_sums))
    return known.mapInArrow(_score(buckets, order), SCORES)
