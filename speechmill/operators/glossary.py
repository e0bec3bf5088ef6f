"""Fuzzy glossaries: windows of a text that sound like a name of the glossary, to an edit distance of 1.

A text is cut into segments, a segment into units (characters or words), each with a reading. A window of as many units
as a name has, or one more or less, is the name if their readings are equal, or, for names whose reading has
``LEAST_LETTERS`` letters or more, if one letter's change, loss or gain makes them equal. Instead of comparing all windows
with all names, both list what they become by losing one letter: readings that are one edit apart share one of these,
so an equi-join on them finds every pair, and a comparison of the pair confirms it. So the glossary may have any size.

What a reading becomes is a 64-bit key, worked out in Arrow batches from sums over its letters. Windows are listed within
a batch, and only those go on that have a key which a name may have, as a bitmap of the names' keys tells (a Bloom filter).
So what is shuffled grows with the windows near a name, not with all windows and their letters; the bitmap has
``KEY_BITS`` bits for each key and ``MOST_BITS`` at most, beyond which more windows go on and the result stays the same.

Distinct readings are joined, not windows, so a phrase that a third of all texts hold is compared once. In each segment
the first match counts, by the names' order, then the window of the name's own size, one longer, one shorter, then by place.
As a window isn't replaced by what it says itself, two names for each reading are enough to find it. Up to ``MOST_OFFERS``
of these are given to all tasks, which look up their windows (by 128 bits of hash) and send on each segment's first match;
beyond that the windows near a name are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_LETTERS = 6
KEY_BITS, MOST_BITS, MOST_OFFERS = 32, 1 << 28, 1 << 22
# Bits of a block of the bitmap (as bitmap_or_agg takes them), bytes of text and lost letters that are worked on at once.
BLOCK, TEXT, LOSSES = 1 << 15, 1 << 20, 1 << 18
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_PROBES = tuple(map(np.uint64, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)))
_SHORT = np.uint64(0xA0761D6478BD642F)  # sets keys of names too short for an edit apart from the others


def _codes() -> np.ndarray:
    """A number for each byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * _PROBES[0]
    x = (x ^ (x >> np.uint64(27))) * _PROBES[1]
    return x ^ (x >> np.uint64(31))


_CODES = _codes()


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = (np.full(n, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class _Letters:
    """Strings side by side (UTF-8): keys of runs of their letters, and of such runs less one letter."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        first = (data & 0xC0) != 0x80
        up, self.down = _powers(max(TEXT, 1 << len(data).bit_length()) + 1, base)
        self.at = np.append(np.flatnonzero(first), len(data))  # a letter's first byte
        self.number = np.concatenate([[0], np.cumsum(first)])  # letters before a byte
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * up[: len(data)])])

    def whole(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a = self.at[start]
        return (self.sums[self.at[end]] - self.sums[a]) * self.down[a]

    def less_one(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each letter of each run: which run, and its key without the letter."""
        size = end - start
        run = np.repeat(np.arange(len(size)), size)
        letter = np.arange(len(run)) + (start - np.cumsum(size) + size)[run]
        a, x, y = self.at[start][run], self.at[letter], self.at[letter + 1]
        return run, ((self.sums[x] - self.sums[a]) + (self.sums[self.at[end]][run] - self.sums[y]) * self.down[y - x]) * self.down[a]

    def keys(self, start: np.ndarray, end: np.ndarray, least: int, named: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of (which run, key) for runs that are names' readings, or else are heard."""
        size, whole = end - start, self.whole(start, end)
        short, long = np.flatnonzero(size < least), np.flatnonzero(size >= least)
        yield short, whole[short] ^ _SHORT
        near = long if named else np.flatnonzero(size >= least - 1)
        yield near, whole[near]
        ends = np.cumsum(size[long])
        for part in np.split(long, np.searchsorted(ends, np.arange(LOSSES, ends[-1], LOSSES)) if len(long) else []):
            run, key = self.less_one(start[part], end[part])
            yield part[run], key


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the strings and where each begins and ends; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _parts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows some of which have about ``TEXT`` bytes together. ends: 0 bytes in, then each row's end."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT, side="right")) - 1)
        yield at, to
        at = to


def _gathered(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Lists for n rows. rows: of each value, in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _listed(pieces: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    run, key = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(run, kind="stable")
    return _gathered(run[order], n, pa.array(key[order].view(np.int64)))


def _whole_keys(column: pa.Array, base: int = _BASE) -> np.ndarray:
    """A key of each string."""
    data, at = _strings(column)
    found = [np.zeros(0, np.uint64)]
    for i, j in _parts(at):
        letters = _Letters(data[at[i] : at[j]], base)
        ends = letters.number[at[i : j + 1] - at[i]]
        found.append(letters.whole(ends[:-1], ends[1:]))
    return np.concatenate(found)


def _string_keys(column: pa.Array, least: int, named: bool) -> Iterator[pa.Array]:
    data, at = _strings(column)
    for i, j in _parts(at):
        letters = _Letters(data[at[i] : at[j]])
        ends = letters.number[at[i : j + 1] - at[i]]
        yield _listed(list(letters.keys(ends[:-1], ends[1:], least, named)), j - i)


def _keys(reading: str, least: int, named: bool) -> Column:
    """Keys of readings, each once."""

    @F.arrow_udf("array<bigint>")
    def keys(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(pa.int64())), *_string_keys(column, least, named)])

    return F.array_distinct(keys(reading))


def _places(keys: np.ndarray, probe: np.uint64, bits: int) -> np.ndarray:
    return ((keys * probe) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _mark(bitmap: np.ndarray, keys: np.ndarray) -> None:
    for probe in _PROBES:
        at = _places(keys, probe, 8 * len(bitmap))
        np.bitwise_or.at(bitmap, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def _bits(keys: int) -> int:
    return min(MOST_BITS, max(BLOCK, 1 << (keys * KEY_BITS).bit_length()))


def _may_have(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be marked."""
    there = np.arange(len(keys))
    for probe in _PROBES:
        at = _places(keys[there], probe, 8 * len(bitmap))
        there = there[(bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
    return there


def _bitmap(names: DataFrame, keys: int, least: int) -> np.ndarray:
    """A bitmap of the readings' keys, made where they are and put together block by block. keys: about how many."""
    bits = _bits(keys)

    def marked(batches):
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for lists in _string_keys(batch.column(0), least, True):
                _mark(bitmap, lists.values.to_numpy().view(np.uint64))
        blocks = bitmap.reshape(-1, BLOCK // 8)
        full = np.flatnonzero(blocks.any(axis=1))
        for k in range(0, len(full), 64):
            yield pa.RecordBatch.from_arrays([pa.array(full[k : k + 64], pa.int64()), pa.array([blocks[i].tobytes() for i in full[k : k + 64]], pa.binary())], ["block", "bits"])

    blocks = names.select("reading").mapInArrow(marked, "block long, bits binary").groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    bitmap = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for r in blocks.collect():  # MOST_BITS at most
        bitmap[r.block] = np.frombuffer(r.bits, np.uint8)
    return bitmap.ravel()


def _alike(heard: DataFrame, names: DataFrame, least: int) -> DataFrame:
    """Distinct rows of ``heard`` and the readings of ``names``, equal or one edit apart. heard: heard, _key and more."""
    b = names.select("reading").filter("reading <> ''").distinct()
    b = b.select("reading", F.explode_outer(_keys("reading", least, True)).alias("_key"))
    near = (F.col("heard") == F.col("reading")) | (F.char_length("reading") >= least) & (F.levenshtein("heard", "reading", 1) == 1)
    return heard.join(b, "_key").filter(near).drop("_key").distinct()


def similar_readings(heard: DataFrame, names: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """Distinct (heard, reading) of the columns of that name, equal or one edit apart where ``reading`` has ``least`` letters."""
    a = heard.select("heard").filter("heard <> ''").distinct()
    return _alike(a.select("heard", F.explode_outer(_keys("heard", least, False)).alias("_key")), names, least)


class _Lines:
    """Segments' readings side by side, and their runs of units. data, at: as ``_strings`` tells the lists' values."""

    def __init__(self, lists: pa.Array, data: np.ndarray, at: np.ndarray):
        first = lists.offsets.to_numpy()
        self.first, at = first - first[0], at[first[0] : first[-1] + 1]
        self.data = data[at[0] : at[-1]]
        self.letters = _Letters(self.data)
        self.ends = self.letters.number[at - at[0]]
        self.row = np.repeat(np.arange(len(lists)), np.diff(first))

    def runs(self, width: int, lengths: np.ndarray) -> np.ndarray:
        """The first units of runs within a segment that have one of these lengths."""
        unit = np.flatnonzero(np.arange(len(self.row)) + width <= self.first[1:][self.row])
        return unit[np.isin(self.ends[unit + width] - self.ends[unit], lengths)]


def _fits(sizes: list[tuple[int, int, int]], least: int) -> dict[int, np.ndarray]:
    """Widths of windows that some name may have, and their numbers of letters. sizes: (units, letters, how often) of the names."""
    fits = {}
    for n, letters, _ in sizes:
        for width in range(max(n - 1, 2), n + 2):
            fits.setdefault(width, set()).update((letters - 1, letters, letters + 1) if letters >= least else (letters,))
    return {w: np.array(sorted(x - {0, -1})) for w, x in sorted(fits.items())}


def _part(units: str, by: str) -> Column:
    return F.array_join(F.slice(units, F.col("w.pos") + 1, F.col("w.width")), by)


def windows(segments: DataFrame, key: list[str], units: str, readings: str, fits: dict[int, np.ndarray], bitmap: np.ndarray, least: int = LEAST_LETTERS) -> DataFrame:
    """``key``, pos (from 0), width, said (units side by side), heard (their readings), keys: every run of two units or more that may be near a name.

    keys: those of the run that names may have.
    """
    told = segments.sparkSession.sparkContext.broadcast(bitmap)

    def near(lists: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.Array:
        lines, found = _Lines(lists, data, at), []
        for width, lengths in fits.items():
            unit = lines.runs(width, lengths)
            pieces = [(run[may], key[may]) for run, key in lines.letters.keys(lines.ends[unit], lines.ends[unit + width], least, False) for may in [_may_have(told.value, key)]]
            run, key = (np.concatenate(x) for x in zip(*pieces, strict=True))
            found.append((unit[run], np.full(len(run), width), key))
        unit, width, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((width, unit))
        unit, width, key = unit[order], width[order], key[order]
        new = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (width[1:] != width[:-1]))[: len(unit)])
        line = lines.row[unit[new]]
        keys = pa.ListArray.from_arrays(pa.array(np.append(new, len(key)), pa.int32()), pa.array(key.view(np.int64)))
        runs = pa.StructArray.from_arrays([pa.array(unit[new] - lines.first[line], pa.int32()), pa.array(width[new], pa.int32()), keys], ["pos", "width", "keys"])
        return _gathered(line, len(lists), runs)

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("width", pa.int32()), ("keys", pa.list_(pa.int64()))]))

    @F.arrow_udf("array<struct<pos:int,width:int,keys:array<bigint>>>")
    def found(lists: pa.Array) -> pa.Array:
        data, at = _strings(lists.values)
        return pa.concat_arrays([pa.array([], kind), *(near(lists[i:j], data, at) for i, j in _parts(at[lists.offsets.to_numpy()]))])

    runs = segments.select(*key, units, readings, F.explode_outer(found(readings)).alias("w")).filter("w is not null")  # an inner explode would be asked for its size before, by listing all twice more
    return runs.select(*key, "w.pos", "w.width", _part(units, " ").alias("said"), _part(readings, "").alias("heard"), "w.keys")


def _offers(near: DataFrame, names: DataFrame) -> DataFrame:
    """heard, width, name, place, rank: the first two names for each window, as one of them may be what it says. near: heard, width, reading."""
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*(c for c in ("place", "rank") if c in df.columns), "name"))).filter("_n <= 2").drop("_n")
    some = first(names.groupBy("name", "reading", "n").agg(F.min("place").alias("place")), "reading", "n")
    rank = F.when(F.col("width") == F.col("n"), 0).when(F.col("width") > F.col("n"), 1).otherwise(2)
    fit = near.join(some, "reading").filter(F.abs(F.col("width") - F.col("n")) <= 1).withColumn("rank", rank)
    fit = fit.groupBy("heard", "width", "name").agg(F.min(F.struct("place", "rank")).alias("at")).select("heard", "width", "name", "at.*")
    return first(fit, "heard", "width")


class _Offers:
    """Offers in order of their windows' keys, then of place and rank: a window's first and perhaps second one."""

    def __init__(self, table: pa.Table):
        named = pc.unique(table["name"])
        self.names = named.take(pc.sort_indices(named))
        place = pc.unique(table["place"])
        place = place.take(pc.array_sort_indices(place, null_placement="at_start"))
        order = pc.index_in(table["place"], value_set=place).to_numpy() * 3 + table["rank"].to_numpy()
        self.own = _whole_keys(self.names)
        key, check = (self.key(_whole_keys(table["heard"].combine_chunks(), base), table["width"].to_numpy()) for base in (_BASE, _OTHER))
        by = np.lexsort((order, key))
        self.keys, self.checks, self.order, self.name = key[by], check[by], order[by], pc.index_in(table["name"], value_set=self.names).to_numpy()[by]
        self.bitmap = np.zeros(_bits(len(key)) // 8, np.uint8)
        _mark(self.bitmap, key)

    @staticmethod
    def key(heard: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return (heard + np.atleast_1d(width).astype(np.uint64) * _PROBES[2]) * _PROBES[3]

    def plain(self) -> bool:
        """Whether each key is one window's."""
        same = self.keys[1:] == self.keys[:-1]
        return not (same[1:] & same[:-1]).any() and not (same & (self.checks[1:] != self.checks[:-1])).any()

    def find(self, key: np.ndarray, check: np.ndarray, said: np.ndarray) -> np.ndarray:
        """The offer for each window by its number, or -1."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[at] == key) & (self.checks[at] == check)
        other = there & (self.own[self.name[at]] == said)
        after = np.minimum(at + 1, len(self.keys) - 1)
        there &= ~other | (after > at) & (self.keys[after] == key)
        return np.where(there, np.where(other, after, at), -1)


def _first_hits(segments: DataFrame, key: list[str], units: str, readings: str, fits: dict[int, np.ndarray], offers: _Offers) -> DataFrame:
    """``key``, pos, width, said, name, at (order of place and rank): the first match of each row that has one."""
    told = segments.sparkSession.sparkContext.broadcast(offers)

    def first(lists: pa.Array, data: np.ndarray, at: np.ndarray, spoken: pa.Array, words: np.ndarray, word: np.ndarray) -> pa.Array:
        offers, lines, said = told.value, _Lines(lists, data, at), _Lines(spoken, words, word)
        other, found = _Letters(lines.data, _OTHER), []
        for width, lengths in fits.items():
            unit = lines.runs(width, lengths)
            keys = offers.key(lines.letters.whole(lines.ends[unit], lines.ends[unit + width]), width)
            may = _may_have(offers.bitmap, keys)
            unit, keys = unit[may], keys[may]
            row = lines.row[unit]
            pos = unit - lines.first[row]
            a, z = (said.ends[np.minimum(said.first[row] + pos + w, said.first[row + 1])] for w in (0, width))
            offer = offers.find(keys, offers.key(other.whole(lines.ends[unit], lines.ends[unit + width]), width), said.letters.whole(a, np.maximum(z - 1, a)))
            hit = offer >= 0
            found.append((row[hit], pos[hit], np.full(hit.sum(), width), offer[hit]))
        row, pos, width, offer = (np.concatenate(x) for x in zip(*found, strict=True))
        order, name = offers.order[offer], offers.name[offer]
        by = np.lexsort((name, pos, order, row))
        by = by[np.append(True, np.diff(row[by]) > 0)[: len(by)]]
        runs = [pa.array(pos[by], pa.int32()), pa.array(width[by], pa.int32()), offers.names.take(pa.array(name[by])).cast(pa.string()), pa.array(order[by], pa.int64())]
        return _gathered(row[by], len(lists), pa.StructArray.from_arrays(runs, ["pos", "width", "name", "at"]))

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("width", pa.int32()), ("name", pa.string()), ("at", pa.int64())]))

    @F.arrow_udf("array<struct<pos:int,width:int,name:string,at:bigint>>")
    def found(lists: pa.Array, spoken: pa.Array) -> pa.Array:
        (data, at), (words, word) = _strings(lists.values), _strings(spoken.values)
        return pa.concat_arrays([pa.array([], kind), *(first(lists[i:j], data, at, spoken[i:j], words, word) for i, j in _parts(at[lists.offsets.to_numpy()]))])

    spoken = F.transform(units, lambda u: F.concat(u, F.lit(" ")))
    runs = segments.select(*key, units, F.explode_outer(found(readings, spoken)).alias("w")).filter("w is not null")
    return runs.select(*key, "w.pos", "w.width", _part(units, " ").alias("said"), "w.name", "w.at")


def matches(segments: DataFrame, key: list[str], units: str, readings: str, names: DataFrame, least: int = LEAST_LETTERS, most_offers: int = MOST_OFFERS) -> DataFrame:
    """The match of each segment that has one: ``key``, pos, width, said, name. names: place, name (units joined by spaces), reading, n (units)."""
    sizes = [tuple(r) for r in names.groupBy("n", F.char_length("reading").alias("letters")).count().collect()]  # lengths of names, a few numbers
    fits = _fits(sizes, least)
    found = windows(segments, key, units, readings, fits, _bitmap(names, sum(m * (k + 1 if k >= least else 1) for _, k, m in sizes), least), least)
    near = _alike(found.select("heard", "width", F.explode_outer("keys").alias("_key")).distinct(), names, least)
    offers = _offers(near, names)
    some = offers.limit(most_offers + 1).toArrow() if fits else ()
    listed, none = _Offers(some) if 0 < len(some) <= most_offers else None, not len(some)
    del some
    if listed is not None and listed.plain():
        hit, at = _first_hits(segments, key, units, readings, fits, listed), ["at", "pos", "name"]
    else:
        hit, at = found.join(offers, ["heard", "width"]).filter(F.col("said") != F.col("name")), ["place", "rank", "pos", "name"]
        hit = hit.limit(0) if none else hit
    first = F.min_by(F.struct("pos", "width", "said", "name"), F.struct(*at))
    return hit.groupBy(*key).agg(first.alias("m")).select(*key, "m.*")


def replaced(units: Column, pos: Column, width: Column, name: Column) -> Column:
    """The segment's units with the match replaced by the name; unchanged where there is none (null)."""
    changed = F.concat(F.slice(units, F.lit(1), pos), F.array(name), F.slice(units, pos + width + 1, F.greatest(F.size(units) - pos - width, F.lit(0))))
    return F.when(name.isNull(), units).otherwise(changed)


def glossary(names: DataFrame, units: Column, readings: Column, order: str) -> DataFrame:
    """Names as ``matches`` takes them; of equal names the first by ``order`` counts."""
    rows = names.select(F.array_join(units, " ").alias("name"), F.array_join(readings, "").alias("reading"), F.size(units).alias("n"), F.col(order).alias("place"))
    return rows.filter("reading <> ''").groupBy("name", "reading", "n").agg(F.min("place").alias("place"))
