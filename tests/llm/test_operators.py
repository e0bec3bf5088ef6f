import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import same
from speechmill.llm import bpe, decontam, fingerprint, html, linedup, minhash, ngram_lm, queries, ranking, rollup, sharding
from speechmill.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, a repeated row, a null id, columns that operators use themselves.
ODD = [(1, None, "x", 1), (2, "", "x", 2), (3, " \n ", None, 3), (4, "one two", "y", 4), (4, "one two", "y", 4), (None, "one two", "z", 5), (6, "word " * 5000, "z", 6), (7, "é 🎈 " * 30, "z", 7)]
ODD_SCHEMA = "doc_id long, text string, score string, n_words int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def words(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_op1(spark, sf_dir, texts, odd, none):
    got = {r.doc_id: r for r in queries.op1_fingerprint(spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    shingles = lambda t: set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False))
    for i, at in enumerate(order):
        text, after = texts[at], texts[order[(i + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[at].n_chars, got[at].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        if a and b:
            assert abs(got[at].near_edited - len(a & b) / len(a | b)) < 0.25
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert fingerprint.fingerprints(none).count() == 0


def test_op1_merge_and_containment(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(90)))], "a string, b string")
    made = fingerprint.add_sketches(df, {"x": "a", "y": "b"})
    row = made.select(fingerprint.containment(F.col("y"), F.col("x")).alias("c"), (fingerprint.merge(F.col("x"), F.col("y")) == F.col("x")).alias("same")).first()
    assert row.c == 1.0 and row.same


def test_op2(spark, sf_dir, texts, odd, none):
    got = {r.doc_id: r for r in queries.op2_ngram_lm(spark, sf_dir).collect()}
    train = {d: words(t) + [b""] for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10}
    count = Counter(w for ws in train.values() for w in ws)
    n, v = sum(count.values()), len(count)
    for d, t in texts.items():
        ws = words(t) + [b""]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, d not in train)
        assert r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    rows = ngram_lm.score_documents(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    assert ngram_lm.score_documents(none).count() == 0


def test_op2_probabilities_sum_to_one(spark):
    rows = [(d, t) for d, t in zip(range(20), ["a b a", "b c", "a b", "c a", "d"] * 4, strict=True)]
    known = {w.decode() for d, t in rows if zlib.crc32(str(d).encode()) % 10 for w in words(t)}
    held_out = (d for d in itertools.count(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    every = [" ".join(t) for n in range(7) for t in itertools.product([*sorted(known), "never"], repeat=n)]
    docs = spark.createDataFrame(rows + list(zip(held_out, every)), "doc_id long, text string")
    mass = Counter()
    for r in ngram_lm.score_documents(docs).collect():
        if r.doc_id >= 1000:
            mass[r.n_tokens - 1] += 10**r.score
    # All texts of up to six words, and those of more by the ratio at which their share falls with each word.
    ratio = mass[6] / mass[5]
    assert 0 < ratio < 0.7 and sum(mass.values()) < 1
    assert sum(mass.values()) + mass[6] * ratio / (1 - ratio) == pytest.approx(1, abs=2e-3)


@pytest.mark.parametrize("order", [2, 3])
def test_op2_scores_do_not_depend_on_chunks(spark, order):
    draw = random.Random(5)
    docs = {d: " ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(draw.randrange(80))) for d in range(300)}
    train = [words(t) + [b""] for d, t in docs.items() if zlib.crc32(str(d).encode()) % 10]
    count = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip([None, *ws], ws, strict=False))
    triples = Counter(p for ws in train for p in zip([None, *ws], ws, ws[1:], strict=False))
    follow = Counter(p[0] for p in pairs.elements())
    size = {v: int(math.log2(n)) for v, n in follow.items()}
    total, once = Counter(), Counter()
    for (v, _), n in pairs.items():
        total[size[v]] += n
        once[size[v]] += n == 1
    states = {p: int(math.log2(n)) for p, n in pairs.items() if n >= 2 and order == 3}
    total_two, once_two = Counter(), Counter()
    for (u, v, _), n in triples.items():
        if (u, v) in states:
            total_two[states[u, v]] += n
            once_two[states[u, v]] += n == 1
    n, kinds = sum(count.values()), Counter(count.values())
    d = min(max((kinds[1] + 1) / (kinds[1] + 2 * kinds[2] + 2), 0.05), 0.95)

    def score(ws):
        out = 0
        for u, v, w in zip([None, None, *ws], [None, *ws], ws, strict=False):
            root = (count[w] - d) / n if w in count else d * len(count) / n
            g = (once[size[v]] + 1) / (total[size[v]] + 2) if v in size else 1
            p = (1 - g) * pairs[v, w] / max(follow[v], 1) + g * root
            if v is not None and (u, v) in states:
                h = (once_two[states[u, v]] + 1) / (total_two[states[u, v]] + 2)
                p = (1 - h) * triples[u, v, w] / pairs[u, v] + h * p
            out += math.log10(p)
        return out

    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for chunk_bytes in (500, 3000, 10**6):
        got = {r.doc_id: r.score for r in ngram_lm.score_documents(df, chunk_bytes=chunk_bytes, bucket_bytes=10_000, order=order).collect()}
        assert got == pytest.approx({i: score(words(t) + [b""]) for i, t in docs.items()})


def test_op3(spark, sf_dir, odd, none):
    done = queries.op3_quality_ranking(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out")
    row = done.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("accuracy"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row.accuracy > 0.9 and 0 <= row.lo and row.hi <= 1
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    model = ranking.train(odd, labels, None)
    rows = ranking.score_documents(odd, model, odd.columns, "made").collect()
    assert len(rows) == len(ODD) and all(r.made == 0.5 for r in rows) and rows[0].score == "x"
    assert ranking.score_documents(none, model, ["doc_id"]).count() == 0


def test_op4(spark, sf_dir, texts, odd, none):
    rows = queries.op4_vector_sharding(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items())
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    for measure in (lambda t: len(t.encode()) + 16, lambda t: len(t.split()), lambda t: 1):
        load, sizes = Counter(), [measure(texts[r.doc_id]) for r in rows]
        for r, size in zip(rows, sizes, strict=True):
            load[r.shard] += size
        assert max(load.values()) <= 1.05 * sum(sizes) / 40 + 2 * max(sizes)
    assert sharding.shard_documents(odd).count() == len(ODD)
    assert sharding.shard_documents(none).count() == 0


def test_op4_packs_jointly():
    """Each group goes where the dot product with what is left is highest, by trying all shards."""
    draw = np.random.default_rng(1)
    sizes, scale = draw.pareto(1.5, (300, 3)) + 0.1, np.array([50.0, 60.0, 70.0])
    found, left = sharding.pack(sizes, np.tile(scale, (7, 1)), scale)
    rest = np.ones((7, 3))
    for i in np.argsort(-(sizes / scale).max(axis=1), kind="stable"):
        demand = sizes[i] / scale
        best = max(range(7), key=lambda k: (sum(w * r * d for w, r, d in zip(sharding.WEIGHTS, rest[k], demand, strict=True)), -k))
        assert found[i] == best
        rest[best] -= demand
    assert np.allclose(rest * scale, left)


def test_op4_hot_group(spark):
    docs = spark.createDataFrame([(i, "copy of a text" if i % 3 == 0 else f"text number {i}") for i in range(3000)], "doc_id long, text string")
    sizes = [r.b for r in sharding.shard_documents(docs, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 10 and max(sizes) / min(sizes) < 1.02


def brute_components(docs, width, percent):
    sets = {}
    for d, t in docs.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in docs}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((root(a), root(b)))
                label[rb] = ra
    return {d: root(d) for d in docs}


def test_op3_fit_is_the_least_loss():
    """The fitted weights have the least mean logistic loss over the drawn pairs: plain gradient steps find none lower."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(120, 4))
    label = (x @ np.array([1.0, -2.0, 0.5, 0.0]) + draw.normal(size=120) > 0).astype(int)
    model = ranking.fit(x, label, rivals=3)
    z = ((x - x.mean(0)) / (x.std(0) + 1e-6)).clip(-8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    again, n = np.random.default_rng(0), max(len(good), len(bad)) * 3
    pairs = [(z[good[i % len(good)]], z[bad[j % len(bad)]]) for i, j in zip(again.permutation(n), again.permutation(n), strict=True)]
    weight = np.zeros(4)
    for _ in range(4000):
        gradient = ranking.RIDGE * weight
        for up, down in [(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))]:
            gradient = gradient + ((1 / (1 + np.exp(-((up - down) @ weight))) - 1)[:, None] * (up - down)).mean(0)
        weight -= 0.5 * gradient
    assert np.allclose(weight, model.weight, atol=1e-3)
    errors = lambda cut: np.mean(z[good] @ weight < cut) + np.mean(z[bad] @ weight >= cut)
    assert errors(model.cut) == pytest.approx(min(errors(c) for c in [*(z @ weight - 1e-9), *(z @ weight + 1e-9)]), abs=0.02)


def test_op5_large_groups(spark, odd, none):
    draw = random.Random(3)
    docs, at = {}, 0
    for _ in range(4):
        base = [f"w{draw.randrange(5000)}" for _ in range(90)]
        for _ in range(60):
            copy = list(base)
            for _ in range(draw.randrange(7)):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            docs[at] = " ".join(copy)
            at += 1
    want = brute_components(docs, 5, 80)
    got = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    rows = minhash.near_duplicates(odd, 4).collect()
    assert len(rows) == len(ODD) and all(r.component_id == r.doc_id and r.n_shingles == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert {r.component_id for r in rows if r.n_shingles == 1 and r.doc_id in (4, None)} == {4}
    assert minhash.near_duplicates(none).count() == 0


def test_pipeline_keeps_one_row_of_each_component(spark, odd, none):
    long = lambda k, *more: " ".join([f"{k}{i}" for i in range(60)] + list(more))
    rows = [
        (1, long("a"), "s"), (2, long("a", "end"), "s"), (2, long("b"), "s"),  # the clean text of a shared id stays
        (3, long("c"), "s"), (3, long("c"), "s"), (3, long("c"), "t"),  # repeated rows
        (4, long("d"), "s"), (None, long("d", "end"), "s"), (None, "alone and unique", "s"), (None, None, "s"), (None, " ", "s"),
        (None, long("e"), "s"), (None, long("e"), "s"), (None, long("e", "end"), "s"),  # near copies without any id
        (5, long("f"), "s"), (5, long("f", "end"), "s"),  # near copies under one id
    ]
    got = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept = Counter((r.doc_id, (r.text or "").split()[0] if (r.text or "").split() else r.text) for r in got)
    assert kept == Counter([(1, "a0"), (2, "b0"), (3, "c0"), (4, "d0"), (None, "alone"), (None, None), (None, " "), (None, "e0"), (5, "f0")])
    assert [r.source for r in got if r.doc_id == 3] == ["s"]
    # Of the odd table's three rows with the same two words one stays; wordless rows stay.
    assert sorted(str(r.doc_id) for r in minhash.one_of_each(odd).collect()) == ["1", "2", "3", "4", "6", "7"]
    assert minhash.one_of_each(none).count() == 0


def test_near_dedup_keeps_little_on_disk(spark, monkeypatch):
    tables, names, folders = {}, [], set()
    keep = Scratch.keep

    def watched(self, df, name):
        out, folder = keep(self, df, name), Path(urlparse(self.path).path)
        names.append(name)
        folders.add(folder)
        tables[name] = {p.name for p in folder.iterdir()}
        return out

    monkeypatch.setattr(Scratch, "keep", watched)
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"{text} e{i // 2}") for i in range(40)] + [(99, "alone")], "doc_id long, text string")
    kept = minhash.one_of_each(docs)
    # Bands are gone before texts are read again, and the search's tables before all rows are joined.
    assert not {"signed", "classes-bands"} & tables["leader-pairs"]
    assert {p.name for folder in folders if folder.exists() for p in folder.iterdir()} == {"least", "aside"}
    assert sorted(r.doc_id for r in kept.collect()) == [0, 99]


def test_release_deletes_the_last_shuffle(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for folder in local for p in Path(folder).rglob("shuffle_*")}
    scratch, before = Scratch(spark, "test"), files()
    scratch.keep(spark.range(1000).repartition(3, "id"), "rows")
    new = files() - before
    assert new
    scratch.release()
    for _ in range(50):
        if new & files():
            time.sleep(0.1)
    assert not new & files()


def test_op6(spark, tmp_path):
    counts = {"w": F.regexp_count("text", F.lit(r"\S+"))}
    ledger = rollup.TokenRollup(spark, f"file://{tmp_path}/r", counts)
    change = lambda *rows: spark.createDataFrame(list(rows), "op string, doc_id long, text string, source string, lang string")
    total = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in ledger.totals().collect()}
    assert ledger.totals().count() == 0
    assert ledger.apply("a", change(("upsert", 1, "x y", "s", "en"), ("upsert", 2, None, None, "en"), ("upsert", None, "x", "s", "en"), ("delete", 9, None, None, None)))
    assert total() == {("s", "en"): (1, 2), (None, "en"): (1, 0)}
    assert ledger.apply("b", change(("upsert", 1, "x y z", "s", "de"), ("upsert", 3, "q", "s", "en")))
    assert not ledger.apply("b", change(("upsert", 4, "q", "s", "en")))
    assert total() == {("s", "de"): (1, 3), (None, "en"): (1, 0), ("s", "en"): (1, 1)}
    ledger.apply("c", change(("delete", 3, None, None, None), ("upsert", 2, "a", "t", "en"), ("upsert", 2, "a", "t", "en")))
    assert total() == {("s", "de"): (1, 3), ("t", "en"): (1, 1)}
    ledger.apply("d", change())
    assert total() == {("s", "de"): (1, 3), ("t", "en"): (1, 1)}


def test_op7(spark, sf_dir, texts, odd, none):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op7_byte_bpe(spark, sf_dir).collect():
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    made, draw = bpe.Encoder(path, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", "ab", "the", " ", "é", "🎈", "\n", "1", "!!", "<|endoftext|>", "　"]) for _ in range(draw.randrange(60)))
        assert np.frombuffer(made.encode(text), "<u4").tolist() == other.encode_ordinary(text)
    assert np.frombuffer(made.encode("a" * 3000), "<u4").tolist() == other.encode_ordinary("a" * 3000)
    back = bpe.decode_documents(bpe.encode_documents(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.data)) for r in back) == Counter((o[0], (o[1] or "").encode()) for o in ODD)
    clash = odd.withColumnRenamed("score", "ids")
    rows = bpe.tokenized(clash, ["doc_id", "ids"], path, public_tokenizers.PATTERN).collect()
    assert Counter(r.ids for r in rows) == Counter(o[2] for o in ODD) and all(r.exact and len(r["_ids"]) == r.n_tokens for r in rows)
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0


def test_op8_blocks_and_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, "word word word"), (4, "absent words here")], "item_id long, text string")
    for block in (10**6, 8):
        got = {(r.doc_id, r.score): r for r in decontam.find_contamination(odd, items, ["doc_id", "score"], ("w", "h", "m"), block_bytes=block).collect()}
        assert (got[4, "y"].w, got[4, "y"].h, [m.item for m in got[4, "y"].m]) == (2, 2, ["1"])
        assert got[6, "z"].h == 5000 and got[1, "x"].w == 0 and got[1, "x"].h == 0
    assert sorted(str(r.doc_id) for r in decontam.remove_contaminated(odd, items).collect()) == ["1", "2", "3", "7"]
    assert decontam.find_contamination(none, items, ["doc_id"]).count() == 0
    assert decontam.find_contamination(odd, items.filter("false"), ["doc_id"]).filter("n_hit > 0").count() == 0


def test_op8_repeated_words_are_not_all_pairs(spark):
    items = spark.createDataFrame([(1, "ha " * 800), (2, "a b c d e f g h i j k l")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "ha " * 4000), (2, "x a b c d e f g h i j k l y b c d e f g h i j k")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.find_contamination(docs, items, ["doc_id"]).collect()}
    assert got[1].n_hit == 4000 and len(got[1].matches) < 10
    assert [tuple(m) for m in got[2].matches] == [("2", 1, 0, 12), ("2", 14, 1, 10)]


def test_op9_edges(spark, none):
    line = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, f"{line(1)}\n{line(2)}\nalone"), (2, f"first\n{line(1)}\n\n{line(2)}\nlast"), (2, f"first\n{line(1)}\n\n{line(2)}\nlast"), (3, line(1)), (4, None), (5, f"{line(1)}\n{line(2)}\nalone"), (6, "")]
    docs = spark.createDataFrame([(*r, "e", "s", len(r[1] or "")) for r in rows], DOCS)
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_deleted, r.n_runs) for r in linedup.dedup_lines(docs.filter("text is not null")).collect())
    assert got[0][3] == 0 and got[1] == got[2] == (2, "first\nlast", 4, 2, 1) and got[3][3] == 0 and got[4] == (5, "", 3, 3, 1)
    kept = {r.doc_id: r for r in linedup.without_repeats(docs).collect()}
    assert set(kept) == {1, 2, 3, 4, 6} and kept[2].n_chars == len("first\nlast") and kept[4].text is None
    assert linedup.dedup_lines(none).count() == 0


def brute_runs(docs, min_words):
    """Lines of each document in any run of ``min_words`` words or more that stands earlier too."""
    seen, gone = set(), {d: set() for d in docs}
    for d in sorted(docs):
        lines = [x for x in docs[d].split("\n") if x.split()]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone[d].update(range(i, j))
                    seen.add(run)
    return {d: len(g) for d, g in gone.items()}


@pytest.mark.parametrize("min_words", [3, 10, 25, 60])
def test_op9_is_the_brute_force(spark, min_words):
    draw = random.Random(min_words)
    line = lambda k: " ".join([f"w{k}"] * (1 + k % 4))
    docs = {d: "\n".join(line(draw.randrange(4 if d % 2 else 12)) for _ in range(draw.randrange(40))) for d in range(40)}
    docs |= {40: docs[3], 41: f"{docs[4]}\n{docs[3]}", 42: "\n".join([line(3)] * 70), 43: "\n".join([line(3)] * 50)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.n_deleted for r in linedup.dedup_lines(table, min_words).collect()} == brute_runs(docs, min_words)


def test_op9_suffix_array(spark, tmp_path):
    draw = random.Random(9)
    docs = {d: [draw.randrange(3) for _ in range(draw.randrange(1, 30))] for d in range(30)}
    table = spark.createDataFrame([(d, "\n".join(f"line {k}" for k in ks)) for d, ks in docs.items()], "doc_id long, text string")
    lines = linedup.segments(table, 1, Scratch(spark, "test"))
    code = {(r.doc_id, r.line): r["rank"] for r in lines.collect()}
    suffix = {(d, i): tuple(code[d, j] for j in range(i, len(ks))) for d, ks in docs.items() for i in range(len(ks))}
    ranks = {(r.doc_id, r.line): r["rank"] for r in linedup.suffix_ranks(lines, Scratch(spark, "test")).collect()}
    order = sorted(suffix, key=suffix.get)
    assert set(ranks) == set(suffix)
    assert all((ranks[a] < ranks[b]) == (suffix[a] < suffix[b]) and ranks[a] <= ranks[b] for a, b in itertools.pairwise(order))


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("a<br>b <b>c</b>", "a\nb c"),
        ("<p>one<p>two<div>three</div>", "one\n\ntwo\n\nthree"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>x", "- a\n- b\n  1. c\n\nx"),
        ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"),
        ("<head><title>t</title></head><script>x('<p>')</script>y<span hidden>n</span><i style='display: none'>n</i>", "y"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("x &amp; &lt;y&gt;<!-- no --> z</div></p>", "x & <y> z"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ],
)
def test_op10(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>T</title><p>Hello", "Hello"),
        ("<head>\n<meta charset=x><style>p{}</style><link rel=y>\nHello <b>you</b>", "Hello you"),
        ("<head><noscript><p>n</p></noscript></div><title>T</title></head><body>y", "y"),
        ("<p><svg/> Hello</p>", "Hello"),
        ("<p>a<math /> b<svg width='1'/> c</p>", "a b c"),
        ("<p>x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>z</annotation></math></p>", "x y=2"),
        ("<svg>no<title/><style/><defs><text>no</text></defs><desc>no</desc><g><text>one</text><text><tspan>two</tspan></text></g></svg>three", "one two three"),
        ("<svg><path d=a/>no<foreignObject><p>yes</foreignObject></svg><svg><g><p>out", "yes\n\nout"),
        ("a <span aria-hidden=true>b</span><span aria-hidden='true' hidden>n</span> c", "a b c"),
    ],
)
def test_op10_head_and_foreign_elements(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<p class="a"">Text', "Text"),
        ('<p class="a"">Text <a href="b">more</a> end', "Text more end"),
        ("<a href=x title=don't>Text", "Text"),
        ("<a href=x title=don't>Text</a> isn't <b 'x>lost</b>", "Text isn't lost"),
        ("<a title=don'hidden>Text</a>", "Text"),
        ("<a title = 'x > y' href=\"a>b\">Text</a>", "Text"),
        ("<a title= >Text</a>", "Text"),
    ],
)
def test_op10_quotes_in_tags(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>c</table>", "wide  | c\na | b | c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td colspan=1000>a very long head<tr><td>b<td>c</table>", "a very long head\nb | c"),
        ("<table><tr><td rowspan=0 colspan=x>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ],
)
def test_op10_spans(page, text):
    assert html.render(page) == text


def test_op10_deep_nesting_is_linear():
    for tag in ("div", "ul", "span", "blockquote"):
        began = time.time()
        assert html.render(f"<{tag}>" * 20_000 + "one<p>two") == "one\n\ntwo"
        assert time.time() - began < 5, tag


@pytest.mark.parametrize(
    "page",
    [
        "<table>" + "<tr><td>x<td>y" * 2000 + "<tr><td>" + "w" * 40_000 + "<td>z</table>",
        "<table>" + "<tr><td colspan=1000 rowspan=0>a" * 800 + "</table>",
        "<table>" + "".join(f"<tr><td rowspan={n}>a<td>b" for n in range(2000, 2, -2)) + "</table>",
        "<ul><li>x" * 3000,
        "<ol><li>" * 400 + "a<br>" * 4000,
        "<span>" * 20_000 + "one <b>two</b> " * 2000,
        "<div><button>" * 4000 + "<p>a" * 4000,
        "<table><tr><td>a<td>bb" * 2000,
    ],
)
def test_op10_small_pages_stay_small(page):
    began = time.time()
    text = html.render(page)
    assert time.time() - began < 3 and len(text) < 5 * len(page) + 1000


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<div style='display:none'>no <b style='visibility: visible'>no</b></div>y", "y"),
        ("<div style='visibility:hidden'><p>no<div style='VISIBILITY : Visible'><p>one<p>two</div></div>", "one\n\ntwo"),
        ("a<pre>\nb\n\nc</pre>", "a\n\nb\n\nc"),
        ("<textarea>\r\nb</textarea>", "b"),
        ("<table>" + "<tr><td>a<td>b" * 20 + "<tr><td>" + "c" * 400 + "<td>d</table>", "a | b\n" * 20 + "c" * 400 + " | d"),
        ("<table><tr><td><table><tr><td>aaa<td>b<tr><td>c<td>d</table><td>e</table>", "aaa | b c | d | e"),
    ],
)
def test_op10_visibility_newlines_and_padding(page, text):
    assert html.render(page) == text


class _Words(HTMLParser):
    """The visible words of a well-formed page, by a plain reading."""

    void = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__()
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        style = (given.get("style") or "").replace(" ", "").lower()
        gone = tag in html.UNSEEN or "hidden" in given or "display:none" in style or "visibility:hidden" in style
        if tag not in self.void and (self.hidden or gone):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.words += re.findall(r"[^\W_]+", data)


def test_op10_shows_the_words_that_a_plain_parser_shows(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op10_html_text(spark, sf_dir).collect()}
    agree = 0
    for k, page in pages.items():
        plain = _Words()
        plain.feed(page)
        plain.close()
        mine = Counter(re.findall(r"[^\W_]+", re.sub(r"(?m)^\s*(?:- |\d+\. )+", "", got[k])))
        want = Counter(plain.words)
        agree += sum(((mine - want) + (want - mine)).values()) <= 0.02 * sum(want.values())
    assert agree >= 0.9 * len(pages), agree / len(pages)


def test_op10_rows(spark, odd, none):
    pages = odd.withColumnRenamed("text", "html")
    rows = html.extract_text(pages, ["doc_id", "score", "n_words"], "shown").collect()
    assert Counter((r.doc_id, r.score, r.shown) for r in rows) == Counter((o[0], o[2], " ".join((o[1] or "").split())) for o in ODD)
    assert html.extract_text(none.withColumnRenamed("text", "html"), ["doc_id"]).count() == 0


def test_op10_whole_table(spark, sf_dir):
    done = queries.op10_html_text(spark, sf_dir)
    assert done.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert done.filter("text rlike '</?[a-z]+>' or text like '%track(%'").count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns and docs.count() <= before, name
        before = docs.count()
    assert set(brute_components({r.doc_id: r.text for r in docs.collect()}, 5, 80).items()) == {(r.doc_id, r.doc_id) for r in docs.collect()}
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.count() == before and done.filter("not exact").count() == 0


def test_op3_copied_ids_do_not_change_the_model(spark, sf_dir):
    """Rows of one doc_id in any order, and more of them than the sample: one model."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    copies = docs.unionByName(docs.withColumn("text", F.reverse("text"))).unionByName(docs)
    models = [ranking.train(copies.repartition(n), labels) for n in (1, 7)]
    assert (models[0].weight == models[1].weight).all() and models[0].cut == models[1].cut


def test_op2_chunks_of_shuffled_input(spark, sf_dir):
    """Answers fit a chunk's order, so rows in another order of arrival are scored the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scores = [{r.doc_id: round(r.score, 6) for r in ngram_lm.score_documents(d, chunk_bytes=200_000).collect()} for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(3))]
    assert scores[0] == scores[1]


def test_op6_compaction(spark, tmp_path):
    """Totals and later batches are the same with compactions between; batches stay committed, old attempts can go."""
    counts = {"w": F.regexp_count("text", F.lit(r"\S+"))}
    plain, tidy = (rollup.TokenRollup(spark, str(tmp_path / n), counts) for n in ("plain", "tidy"))
    schema = "op string, doc_id long, text string, source string, lang string, sign int"
    batches = [[("upsert", 1, "a b", "s", None, 7), ("upsert", 2, "c", None, "l", 7)], [("delete", 2, None, None, None, 7), ("upsert", 1, "a b c", "t", "l", 7), ("delete", 9, None, None, None, 7)], [], [("upsert", 2, "x y", "s", "l", 7)]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        assert plain.apply(f"b{n}", df) and tidy.apply(f"b{n}", df)
        assert tidy.compact(f"tidy-{n}") and not tidy.compact(f"tidy-{n}") and not tidy.apply(f"b{n}", df)
        if n % 2:
            assert tidy.vacuum() >= 1 and tidy.vacuum() == 0
        assert len(tidy.live()) == 1
        for one, other in ((plain.totals(), tidy.totals()), (plain.present(), tidy.present())):
            assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(map(str, other.select(sorted(one.columns)).collect()))
    assert set(tidy.committed()) == {f"b{n}" for n in range(4)} | {f"tidy-{n}" for n in range(4)}


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, clashing names: each stage alone keeps its columns; an empty table stays empty."""
    import corpus_pipeline

    schema = DOCS + ", score string, body string, _t string, n_words int, label string, runs int"
    rows = [(o[0], o[1], None if i % 2 else "en", o[2], i, "s", "b", "t", i, "l", None) for i, o in enumerate(ODD)]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, spark.createDataFrame(rows, schema), sf_dir)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert got.count() == len(rows) and got.filter("not exact").count() == 0
        else:
            assert got.columns == spark.createDataFrame([], schema).columns, name
            assert not Counter(map(str, got.drop("text").collect())) - Counter(map(str, spark.createDataFrame(rows, schema).drop("text").collect())), name
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0, name
