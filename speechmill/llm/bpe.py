"""Byte-level BPE: encoding by backtracking from the longest matches, and decoding.

The vocabulary's byte strings, read as Latin-1, go into an Aho-Corasick automaton, which finds every token that
starts at each place of a piece in one pass. From the left the longest token is taken that may stand after the one
before; where none may, the last token is taken back and its place never tried again. Two tokens may stand side by
side if merging their joint bytes gives these two again, which is memoised; a row of such pairs is what the merges
give, so each place is tried once and the time is linear in the piece.

Defined cases: a null text counts as empty and has no tokens; special tokens' strings are ordinary text; repeated rows
have one result each; a very long text takes time in proportion to its length, and its ids are one row; an empty table
gives no rows; carried columns must not have the results' names (``fresh`` gives such).
"""

from __future__ import annotations

import base64
import hashlib
import os

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, text_or_empty

#: Pieces and pairs that a worker remembers; it forgets all and starts again beyond that.
MEMORY = 200_000


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = [b""] * (max(self.ids.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.vocabulary[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern)
        self.packed = _Remembered(self._pack)
        self.fits = _Remembered(self._fit)

    def _merged(self, data: bytes) -> list[bytes]:
        """Merges by rank until no neighbours are a token; only for the few bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            pair = parts[at] + parts[at + 1]
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] + parts[i + 1] == pair:
                    merged.append(pair)
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def _fit(self, pair: tuple[int, int]) -> bool:
        a, b = self.vocabulary[pair[0]], self.vocabulary[pair[1]]
        return self._merged(a + b) == [a, b]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starting: list[list[int]] = [[] for _ in range(n)]  # by length, as longer ones end later
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            starting[end - length + 1].append(rank)
        path: list[int] = []
        dead, at = bytearray(n + 1), 0
        while at < n:
            options = starting[at]
            while options:
                rank = options.pop()
                end = at + len(self.vocabulary[rank])
                if not dead[end] and (not path or self.fits[path[-1], rank]):
                    path.append(rank)
                    at = end
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary has no token for a byte of the text")
                dead[at] = 1
                at -= len(self.vocabulary[path.pop()])
        return path

    def _pack(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class _Remembered(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        self[key] = value = self.make(key)
        return value


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process. Where a worker lacks ``path``, the file of that name that is installed there counts."""
    if (path, pattern) not in _encoders:
        here = path
        if not os.path.exists(here):
            import public_tokenizers

            here = public_tokenizers.path(os.path.basename(path))
        _encoders[path, pattern] = Encoder(here, pattern)
    return _encoders[path, pattern]


def _texts(batch: pa.RecordBatch):
    return (t or "" for t in batch.column("text").to_pylist())


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its text, an array of ints."""

    def encoded(batches):
        make = encoder(path, pattern)
        for batch in slices(batches, 200):
            ids = [np.frombuffer(make.encode(t), "<u4").astype(np.int32) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""

    def decoded(batches):
        make = encoder(path, pattern)
        for batch in slices(batches, 200):
            data = [make.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decoded, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to; texts and ids stay in the task."""

    def digests(batches):
        make = encoder(path, pattern)
        for batch in slices(batches, 200):
            rows = []
            for text in _texts(batch):
                packed = make.encode(text)
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(make.decode(packed)).hexdigest()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, carry: list[str], path: str, pattern: str) -> DataFrame:
    """The columns ``carry``, ``n_tokens``, ``ids``, and ``exact``: the ids decode to the text's bytes.

    Where ``carry`` has such a name, the new column has underscores before it.
    """
    names = [fresh(docs.select(*[F.col(f"`{c}`") for c in carry]), n) for n in ("n_tokens", "ids", "exact")]

    def made(batches):
        make = encoder(path, pattern)
        for batch in slices(batches, 200):
            texts = ["" if t is None else t for t in batch.column(batch.num_columns - 1).to_pylist()]
            packed = [make.encode(t) for t in texts]
            exact = [make.decode(p) == t.encode() for p, t in zip(packed, texts, strict=True)]
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(exact)], [*carry, *names])

    source = docs.select(*[F.col(f"`{c}`") for c in carry], text_or_empty().alias(fresh(docs, "body")))
    new = [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.ArrayType(T.IntegerType()), T.BooleanType()), strict=True)]
    return source.mapInArrow(made, T.StructType([*source.schema.fields[:-1], *new]))
