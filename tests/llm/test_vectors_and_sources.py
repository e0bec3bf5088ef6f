"""op11 to op13 against brute force, on odd tables and under other block sizes."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmill.llm import codes, divergence, neighbours

VECTORS = "vec_id long, embedding array<float>, label int, ids string, row string, code string"
NAN, INF = float("nan"), float("inf")


def asks():
    return F.pmod(F.col("vec_id"), F.lit(20)) == 0


def odd_vectors(n=600, dim=8, seed=3):
    """Null, empty, zero and non-finite vectors, another length, a hot vector, repeated rows and ids, null ids and labels."""
    draw = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=dim)], int(i % 3) if i % 7 else None) for i in range(n)]
    rows += [(n + i, rows[5][1], 9) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [rows[0], rows[0], rows[20], (40, rows[41][1], 1), (None, rows[3][1], 1), (None, None, 1)]
    rows += [(-20, [0.0] * dim, 2), (-40, [NAN] + [0.5] * (dim - 1), 2), (-60, [INF] * dim, 2), (-80, [None] + [0.5] * (dim - 1), 2), (-100, None, 2), (2000, [1.0] * (dim // 2), 4), (2020, [2.0] * (dim // 2), 4), (2040, [], 4)]
    return [(*r, "a", "b", "c") for r in rows]


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def nearest_by_hand(rows, k):
    rows = [(i, n, [float(x) for x in v]) for n, (i, v, *_) in enumerate(rows) if finite(v) and any(v)]
    out = []
    for i, n, v in rows:
        if i is None or i % 20:
            continue
        found = []
        for j, m, w in rows:
            if m != n and len(v) == len(w):
                score = 0.0
                for a, b in zip(v, w, strict=True):
                    score += a * b
                found.append((-score, j is None, j or 0, m))
        out += [(i, r, None if none else j, -s) for r, (s, none, j, _) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize(("k", "sizes"), [(20, {}), (5, {"block_rows": 64, "query_group": 10, "candidate_group": 100}), (3, {"block_rows": 7})])
def test_op12_is_exact(spark, k, sizes):
    rows = odd_vectors()
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS).repartition(3), asks(), k, **sizes).collect()
    key = lambda r: tuple(-np.inf if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(nearest_by_hand(rows, k), key=key)


def test_op12_near_copies_and_extreme_scales(spark):
    """Vectors nearer to each other than one-byte codes can tell, and lengths from 1e-30 to 1e30."""
    draw = np.random.default_rng(0)
    base = draw.normal(size=6)
    near = [(i, (base + draw.normal(size=6) * 1e-5).tolist(), 0, "", "", "") for i in range(300)]
    far = [(1000 + i, (draw.normal(size=6) * 10.0 ** draw.integers(-30, 30)).tolist(), 0, "", "", "") for i in range(100)]
    rows = [(i, [float(np.float32(x)) for x in v], *rest) for i, v, *rest in near + far]
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS), asks(), 10, block_rows=150).collect()
    assert sorted(map(tuple, got)) == sorted(nearest_by_hand(rows, 10))


def test_op12_bounds_hold():
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(50, 33)) * 10.0 ** draw.integers(-8, 8, (50, 1)), draw.normal(size=(70, 33)) * 10.0 ** draw.integers(-8, 8, (70, 1))
    sides = [neighbours.Side(x, (q := neighbours.quantized(x))[0].astype(np.float32), *q[1:]) for x in (a, b)]
    lower, upper, most = neighbours.bounds(*sides)
    true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / most).T
    assert (lower <= true).all() and (true <= upper).all()
    assert np.median(upper - lower) < 0.2


def test_op12_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], VECTORS), asks()).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(20, [1.0], 1, "", "", "")], VECTORS), asks()).count() == 0


def codes_by_hand(rows, rounds=4, entries=256):
    rows = [(i, list(v), label) for i, v, label, *_ in rows if finite(v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(rows[0][1])
    usable = dim > 0 and dim % 4 == 0
    good = [r for r in rows if usable and len(r[1]) == dim and all(abs(x) < 2**17 for x in r[1])]
    out = [(i, None, None, label) for i, v, label in rows if not (usable and len(v) == dim and all(abs(x) < 2**17 for x in v))]
    books, text = [], ""
    if good:
        whole = [[int(np.floor(1024 * x)) for x in v] for _, v, _ in good]
        width = dim // 4
        parts = [[v[p * width : (p + 1) * width] for v in whole] for p in range(4)]
        books = [[list(x) for x in part[:entries]] for part in parts]
        away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
        assign = lambda: [[min(range(len(book)), key=lambda j, x=x, b=book: (away(x, b[j]), j)) for x in part] for part, book in zip(parts, books, strict=True)]
        for _ in range(rounds):
            for part, book, at in zip(parts, books, assign(), strict=True):
                for j in range(len(book)):
                    mine = [x for x, a in zip(part, at, strict=True) if a == j]
                    if mine:
                        book[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        at = assign()
        for n, (i, _, label) in enumerate(good):
            out.append((i, "".join(f"{at[p][n]:02x}" for p in range(4)), sum(away(parts[p][n], books[p][at[p][n]]) for p in range(4)), label))
        text = ",".join(str(x) for book in books for entry in book for x in entry)
    sums = {}
    for _, _, error, label in out:
        if error is not None:
            sums[label] = sums.get(label, 0) + error
    return [(i, code, error, sums.get(label), hashlib.sha256(text.encode()).hexdigest()) for i, code, error, label in out]


def no_nulls_first(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("scale", [1.0, 0.002, 3000.0])
def test_op11_is_the_brute_force(spark, scale):
    """0.002: few whole numbers, so ties everywhere; 3000: int64 distances."""
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x * scale)) for x in v], *rest) for i, v, *rest in odd_vectors(150)]
    rows.append((7000, [float(2**17)] * 8, 5, "", "", ""))
    got = codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), size=24).collect()
    assert sorted(map(tuple, got), key=no_nulls_first) == sorted(codes_by_hand(rows, entries=24), key=no_nulls_first)


def test_op11_bounds_spare_scans(spark, sf_dir):
    told = []
    df = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), told=told)
    n = df.count()
    assert len(told) == 4 and told[-1] < 4 * n and sorted(told, reverse=True)[0] == max(told)


def test_op11_large_numbers():
    x = np.array([[2**27, -(2**27)], [5, 6]], np.int64)
    assert codes.distances(x, x)[0, 1] == (2**27 - 5) ** 2 + (2**27 + 6) ** 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0, 3.0], 1, "", "", "")], [(1, [0.5, -0.5, 0.25, 2.0], None, "", "", ""), (2, None, 1, "", "", "")]])
def test_op11_edges(spark, rows):
    got = codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got), key=no_nulls_first) == (sorted(codes_by_hand(rows), key=no_nulls_first) if rows else [])


SOURCES = "lang string, source string, text string, term string, value long, count string"


def audit_by_hand(rows, least, top):
    pattern, low = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [x.translate(low) for x in pattern.findall((text or "").encode())]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for a, s in groups if a == lang]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(sum((counts[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)]
    return sorted(out)


def odd_sources():
    draw = np.random.default_rng(5)
    words = ["alpha", "Beta", "GAMMA", "dé", "Δelta", "x", "naïve", "été", "東京", "q"]
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else f"s{draw.integers(0, 9)}"
        text = " ".join(words[int(k)] + ("-1_" if k % 2 else ", ") for k in draw.integers(0, len(words), draw.integers(0, 12)))
        rows.append(("aa" if i % 4 else "bb", source, text))
    rows += [("aa", "hot", None), ("cc", "only", "one two"), ("dd", "p", ""), ("dd", "q", None), (None, None, "alpha alpha"), ("", "z", "beta"), rows[0], rows[0], ("aa", "long", "word " * 40_000 + "A" * 100_000)]
    return [(*r, "t", 1, "c") for r in rows]


@pytest.mark.parametrize("tiling", [{}, {"block_groups": 2, "chunk_terms": 3, "span_chunks": 2}, {"block_groups": 1, "chunk_terms": 1, "span_chunks": 1}])
def test_op13_is_the_brute_force(spark, tiling):
    rows = odd_sources()
    got = divergence.audit(spark.createDataFrame(rows, SOURCES).repartition(4), least_docs=10, top_terms=4, **tiling).collect()
    assert sorted(map(tuple, got)) == audit_by_hand(rows, 10, 4)


def test_op13_flushes_and_pieces(spark, monkeypatch):
    text = ("Ab1cd é" * 50).encode()
    assert [t for p in divergence.pieces(text, 7) for t in p] == [x.lower() for x in re.findall(rb"[A-Za-z\x80-\xff]+", text)]
    rows = odd_sources()[:40]
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": r[0], "source": r[1], "text": r[2]} for r in rows])
    counts = collections.Counter()
    for part in divergence._counted([batch]):
        for r in part.to_pylist():
            counts[r["lang"], r["source"], r["term"]] += r["count"]
    want = collections.Counter((r[0], r[1], t.lower()) for r in rows for t in re.findall(rb"[A-Za-z\x80-\xff]+", (r[2] or "").encode()))
    assert +counts == +want


def test_op13_shares_are_exact(spark):
    cases = [(0, 1, 1), (90_000_000_000_000, 90_000_000_000_000, 7), (7, 123_456_789_012, 1_000_003), (0, 0, 3)]
    want = [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    assert [int(divergence.shares(np.array([c]), np.array([n]), v)[0]) for c, n, v in cases] == want
    df = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share("c", "n", "v").alias("p"))
    assert [r.p for r in df.collect()] == want


def test_op13_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SOURCES)).count() == 0
