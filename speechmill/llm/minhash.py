"""MinHash near-duplicates with circulant signatures, banding, and exact verification on full shingle sets.

Two permutations make all coordinates: one moves a shingle to a place on a ring, the other ranks the places; the
k-th coordinate is the least rank among the shingles' places, each moved on by k. Texts with equal sets form one
class, and only classes are banded. Classes that share a band are candidates.

A band can hold very many classes, so its pairs are not all emitted. First every class is compared with its band's
central one, which shares most bands with others, and with the least one; linked classes get one label. Where a band
still holds several labels, only pairs of different labels remain, and of these two kinds: pairs with a rare shingle
in common, of which no shingle makes more than RARE * RARE, and pairs whose other shingles alone are enough. The
latter are taken between classes outside the band's main label and all of the band, and classes that have too few
frequent shingles for that are left out before the join. Of both kinds only pairs leave the join whose sets' parities
over 1024 places differ in few enough, a lower bound of what only one of them has. That loses no pair of a band. Each link is confirmed on full
sets: 100 * intersection >= percent * union. What stays open: a band with very many classes that are made of frequent
shingles, like none of the two leaders and yet like others, costs the square of their number in time.

With 40 bands of 6 coordinates a pair at similarity 0.8 misses all bands once in 190,000.

Defined cases: null texts and texts without words are linked with nothing; fewer words than a shingle make one
shingle; rows that share a doc_id are documents of their own; a null doc_id is no candidate for the smallest one; an
empty table gives no rows; a very long text costs memory for its own distinct shingles, 8 bytes each; other columns
of ``docs``, whatever their names, take no part. Where one row of each component stays, a row is its doc_id, its text
and its number among rows that share both. Classes are told apart by 128 bits of their sets, and inside the search by
64 of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, slices, text_or_empty, utf8_values

BANDS, BAND_ROWS, RING = 40, 6, 1 << 20
#: A shingle is rare if so many classes have it at most; a set's parity has so many 64-bit words.
RARE, PARITY = 32, 16
#: Texts go to their classes in so many parts, one after the other, so that the disk holds one part of them at a time.
PARTS = 4
_P = np.uint64(0x9E3779B185EBCA87)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_ring: np.ndarray | None = None


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words of a text."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    run = one[:n].copy()
    for k in range(1, width):
        run = (run ^ (run >> np.uint64(32))) * _P + one[k : k + n]
    run = (run ^ (run >> np.uint64(29))) * _Q
    return np.unique(run ^ (run >> np.uint64(32)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """BANDS * BAND_ROWS coordinates; the ranks of a place and of those after it lie side by side."""
    global _ring
    size = BANDS * BAND_ROWS
    if _ring is None:
        ranks = np.random.default_rng(20).permutation(RING).astype(np.uint32)
        _ring = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: size - 1]]), size)
    places = ((hashes ^ (hashes >> np.uint64(31))) * _P >> np.uint64(44)).astype(np.int64)
    least = np.full(size, RING, np.uint32)
    for at in range(0, len(places), 2048):
        np.minimum(least, _ring[places[at : at + 2048]].min(axis=0), out=least)
    return least


def _signed(batches, width: int):
    """Size, class and bands of each text, after the columns that are not the text."""
    for batch in slices(batches, 500):
        sizes, high, low, bands = [], [], [], []
        for text in utf8_values(batch.column("text")):
            hashes = shingle_set(text, width)
            sizes.append(len(hashes))
            one, two = _node(hashes)
            high.append(one)
            low.append(two)
            if len(hashes):
                raw = signature(hashes).tobytes()
                step = 4 * BAND_ROWS
                bands.append([xxhash.xxh3_64_intdigest(raw[b * step : (b + 1) * step], b) - (1 << 63) for b in range(BANDS)])
            else:
                bands.append([])
        carried = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], [*carried, "n_shingles", "high", "low", "bands"])


def _node(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(batches, width: int):
    """The sets of the texts, where they are those that ``node`` wants, and for each of 1024 places whether an odd number of their hashes falls there."""
    for batch in slices(batches, 200):
        nodes, found, parity = [], [], []
        for node, text in zip(batch.column("node").to_pylist(), utf8_values(batch.column("text")), strict=True):
            hashes = shingle_set(text, width)
            if _node(hashes)[0] == node:
                nodes.append(node)
                found.append(hashes.view(np.int64))
                odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
                parity.append(np.packbits(odd.astype(bool)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))], ["node", "hashes", "parity"])


def _alike(common, one: str, two: str, percent: int):
    """Whether sets of sizes ``one`` and ``two`` with so many shingles in common are similar enough."""
    return 100 * common >= percent * (F.col(one) + F.col(two) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose full sets are similar enough, without the sets."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("_hb")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("_ha")), "a")
    both = both.select(*pairs.columns, F.size(F.array_intersect("_ha", "_hb")).alias("_i"), F.size("_ha").alias("_na"), F.size("_hb").alias("_nb"))
    return both.filter(_alike(F.col("_i"), "_na", "_nb", percent)).select(*pairs.columns)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the least node that links reach.

    Each round a node takes the least label among its own, its neighbours' and its label's; long chains halve, so
    rounds grow with the logarithm of a component's diameter. A round is one join and one sum; a node with many links
    is spread by the join's skew handling and combined before the sum's shuffle.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), f"{name}-0")
    turn, changed = 0, not labels.isEmpty()
    while changed:
        turn += 1
        own = labels.select(F.col("node").alias("a"), F.col("node").alias("b"))
        up = labels.filter("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b"))
        told = edges.unionByName(own).unionByName(up).join(labels.select(F.col("node").alias("a"), "label"), "a")
        told = told.groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"), F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("before"))
        moved = scratch.keep(told, f"{name}-{turn}")
        changed = not moved.filter("label <> before").isEmpty()
        scratch.drop(f"{name}-{turn - 1}")
        labels = moved.select("node", "label")
    return labels


def _bands(classes: DataFrame) -> DataFrame:
    """(band, node, weight, once) of the bands that several classes share. weight: how many classes share them."""
    rows = classes.select(F.explode("bands").alias("band"), "node")
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    node = Window.partitionBy("node")  # a class has BANDS rows at most
    once = F.row_number().over(node.orderBy("band")) == 1
    return rows.join(shared, "band").select("band", "node", F.sum("size").over(node).alias("weight"), once.alias("once"))


def _leader_pairs(bands: DataFrame) -> DataFrame:
    leaders = bands.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("central"), F.min("node").alias("least"))
    pairs = bands.join(leaders, "band").select("node", F.explode(F.array("central.node", "least")).alias("leader")).filter("node <> leader")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _open_rows(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, label, other) of bands that hold several labels. other: not of the band's main label."""
    rows = bands.join(labels, "node", "left").select("band", "node", "weight", F.coalesce("label", "node").alias("label"))
    mixed = rows.groupBy("band").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max(F.struct("weight", "node", "label")).alias("_main")).filter("_lo < _hi")
    return rows.join(mixed.select("band", F.col("_main.label").alias("_main")), "band").select("band", "node", "label", (F.col("label") != F.col("_main")).alias("other"))


def _open_pairs(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b, la, lb): the pairs of different labels in one band that may be similar enough."""
    parity = [f"p{i}" for i in range(PARITY)]
    nodes = rows.groupBy("node").agg(F.first("label").alias("label"))
    held = scratch.keep(sets.join(nodes, "node").select("node", "label", F.size("hashes").cast("bigint").alias("n"), "hashes", *[F.col("parity")[i].alias(w) for i, w in enumerate(parity)]), "open-sets")
    scratch.release()
    shingles = held.select(F.explode("hashes").alias("hash"), "node")
    few = shingles.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= RARE)
    rare = scratch.keep(shingles.join(few, "hash"), "open-rare")
    scratch.release()
    counts = rare.groupBy("node").agg(F.count_if(F.col("c") == 1).alias("alone"), F.count(F.lit(1)).alias("rare"))
    counts = held.select("node", "label", "n", *parity).join(counts, "node", "left").na.fill(0, ["alone", "rare"])
    counts = counts.select("node", "label", "n", *parity, (F.col("n") - F.col("alone")).alias("shared"), (F.col("n") - F.col("rare")).alias("frequent"))
    counts = scratch.keep(counts.filter(100 * F.col("shared") >= percent * F.col("n")), "open-counts")
    scratch.drop("open-sets")

    def pairs(left: DataFrame, right: DataFrame, key: str, most: str) -> DataFrame:
        side = lambda df, k: df.select(key, *[F.col(c).alias(f"{c}_{k}") for c in ("node", "label", "n", most, *parity)])
        met = side(left, "a").join(side(right, "b"), key).filter("label_a <> label_b").filter(_alike(F.least(f"{most}_a", f"{most}_b"), "n_a", "n_b", percent))
        # Each place of unequal parity holds a shingle that one set has and the other lacks.
        apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in parity), F.lit(0))
        met = met.filter(100 * (F.col("n_a") + F.col("n_b") - apart) >= percent * (F.col("n_a") + F.col("n_b") + apart))
        lower = F.col("node_a") < F.col("node_b")
        order = lambda x, y: F.when(lower, F.col(x)).otherwise(F.col(y))
        return met.select(order("node_a", "node_b").alias("a"), order("node_b", "node_a").alias("b"), order("label_a", "label_b").alias("la"), order("label_b", "label_a").alias("lb"))

    able = counts.filter(100 * F.col("frequent") >= percent * F.col("n"))
    banded = rows.select("band", "node", "other").join(able, "node")
    by_rare = rare.filter("c > 1").select("hash", "node").join(counts, "node")
    return pairs(banded.filter("other"), banded, "band", "frequent").unionByName(pairs(by_rare, by_rare, "hash", "shared")).distinct()


def _bodies(docs: DataFrame, wanted: DataFrame, width: int):
    """(node, hashes, parity) of the classes in ``wanted`` (node, _id, _h), in PARTS parts by the rows that stand for them."""
    for k in range(PARTS):
        rows = docs.filter(F.pmod(F.xxhash64("doc_id", "_t"), F.lit(PARTS)) == k)
        some = wanted.filter(F.pmod(F.xxhash64("_id", "_h"), F.lit(PARTS)) == k)
        bodies = rows.join(some, rows["doc_id"].eqNullSafe(some["_id"]) & (rows["_t"] == some["_h"])).select("node", "text")
        sets = bodies.mapInArrow(lambda b: _sets(b, width), "node long, hashes array<long>, parity array<long>")
        yield sets.groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("parity").alias("parity"))


def _labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """The rows of ``docs`` (doc_id, _t, text and long columns) with their classes, (node, low, first, label) of each class, and where both are.

    ``_t`` is a hash of the text. Both tables stay in the shared folder; what led to them is dropped, bands as soon as
    those that several classes share are known.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    carried = ", ".join(f"{c} long" for c in docs.columns if c != "text")
    signed = scratch.keep(docs.mapInArrow(lambda b: _signed(b, width), f"{carried}, n_shingles long, high long, low long, bands array<long>"), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t")
    classes = signed.filter("n_shingles > 0").groupBy(F.col("high").alias("node"), "low").agg(F.min(row).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = scratch.keep(classes, "classes-bands")
    signed = scratch.keep(signed.drop("bands"), "rows")
    scratch.drop("signed")
    bands = scratch.keep(_bands(banded), "bands")
    classes = scratch.keep(banded.drop("bands"), "classes")
    scratch.drop("classes-bands")
    wanted = bands.filter("once").select("node").join(classes, "node").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep._t").alias("_h"))
    sets = scratch.keep_parts(_bodies(docs, scratch.keep(wanted, "wanted"), width), "sets")

    labels = components(scratch.keep(_verified(scratch.keep(_leader_pairs(bands), "leader-pairs"), sets, percent), "leader-links"), scratch, "labels")
    rows = scratch.keep(_open_rows(bands, labels), "open-rows")
    scratch.drop("leader-pairs", "leader-links", "bands", "wanted")
    if not rows.isEmpty():
        pairs = scratch.keep(_open_pairs(rows, sets, percent, scratch), "open-pairs")
        scratch.drop("open-rare", "open-counts")
        links = scratch.keep(_verified(pairs, sets, percent).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "open-links")
        if not links.isEmpty():
            joined = components(links, scratch, "joined").select(F.col("node").alias("label"), F.col("label").alias("_to"))
            # A label may stand for a class that no leader link touched.
            known = labels.join(joined, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
            alone = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("_to").alias("label"))
            labels = known.unionByName(alone)
    heads = classes.join(labels, "node", "left").select("node", "low", F.col("rep.doc_id").alias("first"), F.coalesce("label", "node").alias("label"))
    heads = scratch.keep(heads, "heads")
    scratch.drop("classes", "sets", "open-rows", "open-pairs", "open-links")
    return signed, heads, scratch


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the class of equal sets (high, low), for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("_t"), text_or_empty().alias("text"))
    signed, heads, _ = _labelled(docs, width, percent)
    least = heads.groupBy("label").agg(F.min("first").alias("component_id"))
    homes = heads.join(least, "label").select(F.col("node").alias("high"), "low", "component_id")
    rows = signed.filter("n_shingles > 0").join(homes, ["high", "low"])
    rows = rows.unionByName(signed.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    home = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", home.alias("component_id"), F.col("doc_id").eqNullSafe(home).alias("kept"), "high", "low")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the rows that stay: those without words, and of each component its least row.

    Rows are ordered by doc_id, nulls last, then by two hashes of the text (128 bits), and rows that share all of these
    by their columns as JSON. Only the latter are brought together as whole rows, and combined before they are shuffled.
    """
    key = {"_id": F.col("doc_id").cast("bigint"), "_t": F.xxhash64(text_or_empty()), "_u": F.xxhash64(F.lit(1), text_or_empty())}
    signed, heads, labelled = _labelled(docs.select(key["_id"].alias("doc_id"), key["_t"].alias("_t"), key["_u"].alias("_u"), text_or_empty().alias("text")), width, percent)
    scratch = Scratch(docs.sparkSession, "minhash-rows")
    rows = signed.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), "_t", "_u", "high", "low").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(heads.select(F.col("node").alias("high"), "low", "label"), ["high", "low"]).select("label", F.col("_id").isNull().alias("_null"), "_id", "_t", "_u", "_n")
    rows = scratch.keep(rows, "rows")
    least = scratch.keep(rows.groupBy("label").agg(F.min(F.struct("_null", "_id", "_t", "_u", "_n")).alias("s")).select("label", "s.*"), "least")
    labelled.drop_all()
    several = least.filter("_n > 1")

    def same(left, right: DataFrame):
        return left["_id"].eqNullSafe(right["_id"]) & (left["_t"] == right["_t"]) & (left["_u"] == right["_u"])

    first = least.select("label", F.struct("_id", "_t", "_u").alias("_first"), F.col("_n").alias("_m"))
    aside = rows.join(first, "label").filter((F.struct("_id", "_t", "_u") != F.col("_first")) | (F.col("_m") > 1))
    aside = scratch.keep(aside.select("_id", "_t", "_u"), "aside")  # written, so that the join below knows its size
    scratch.drop("rows")
    stay = docs.join(aside, same(key, aside), "left_anti")
    if several.isEmpty():
        return stay
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.select(whole.alias("_row"), *[v.alias(k) for k, v in key.items()])
    again = again.join(several, same(again, several), "left_semi").groupBy("_id", "_t", "_u").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return stay.unionByName(again.select("_row.*"))
