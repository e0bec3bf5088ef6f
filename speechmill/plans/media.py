"""Frame series, scripts, catalogs and samples as queries over the driver's tables, each beside the SQL that says the same.

Events stand for frames: an item is a user, a frame an event, its pitch the value, and errors are unvoiced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, frames, sampling, scripts
from .corpus import OUTER_SPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _says(sql: str):
    """Registers a query together with its SQL."""

    def register(query):
        QUERIES[query.__name__], ORACLES[query.__name__] = query, sql
        return query

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("item"), pos.alias("pos"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("hz"), "event_id", "event_type", "value")


_F = "f AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS hz, event_id, event_type, value FROM events)"
_STATS = f"{_F}, s AS (SELECT item, count(*) AS n, avg(CASE WHEN hz > 0 THEN 1.0 ELSE 0.0 END) AS voiced_ratio, quantile_cont(hz, 0.5) FILTER (WHERE hz > 0) AS median, stddev_pop(12 * log2(CASE WHEN hz > 0 THEN hz END)) AS std_st FROM f GROUP BY item HAVING max(hz) > 0)"


@_says(f"WITH {_STATS} SELECT item, n, round(voiced_ratio, 6) AS voiced_ratio, round(median, 6) AS median, round(std_st, 5) AS std_st FROM s")
def pitch_stats(spark, sf_dir):
    s = frames.pitch_stats(_frames(spark, sf_dir))
    return s.select("item", "n", F.round("voiced_ratio", 6).alias("voiced_ratio"), F.round("median", 6).alias("median"), F.round("std_st", 5).alias("std_st"))


@_says(f"WITH {_STATS} SELECT count(*) AS n, round(quantile_cont(median, 0.5), 5) AS median, round(avg(std_st), 5) AS std_st, round(quantile_cont(median, 0.1), 5) AS p10, round(quantile_cont(median, 0.9), 5) AS p90 FROM s HAVING count(*) >= 3")
def pitch_fingerprint(spark, sf_dir):
    p = frames.pitch_fingerprint(frames.pitch_stats(_frames(spark, sf_dir)))
    return p.select("n", *[F.round(c, 5).alias(c) for c in ("median", "std_st", "p10", "p90")])


@_says(f"""
    WITH {_F}, b AS (SELECT a.item AS pair, log2(a.hz) AS la, log2(b.hz) AS lb FROM f a JOIN f b ON b.item = a.item + 1 AND b.pos = a.pos WHERE a.hz > 0 AND b.hz > 0),
    o AS (SELECT pair, round_even(quantile_cont(la - lb, 0.5), 0) AS o FROM b GROUP BY pair)
    SELECT pair, CASE WHEN count(*) < 5 THEN 0.0 ELSE round(coalesce(corr(la, lb), 0), 5) END AS r, CASE WHEN count(*) < 5 THEN 1.0 ELSE round(avg(CASE WHEN abs(1200 * (la - lb - o)) > 600 THEN 1.0 ELSE 0.0 END), 6) END AS octave_errors, count(*) AS n_voiced FROM b JOIN o USING (pair) GROUP BY pair""")
def contour_agreement(spark, sf_dir):
    f = _frames(spark, sf_dir)
    one, two = f.select(F.col("item").alias("pair"), "pos", F.col("hz").alias("a")), f.select((F.col("item") - 1).alias("pair"), "pos", F.col("hz").alias("b"))
    return frames.contour_agreement(one.join(two, ["pair", "pos"])).select("pair", F.round("r", 5).alias("r"), F.round("octave_errors", 6).alias("octave_errors"), "n_voiced")


@_says(f"WITH {_F} SELECT item, round(avg(CASE WHEN hz > 120 THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN hz > 120 THEN hz END), 5) AS mean_high FROM f WHERE hz > 0 GROUP BY item")
def high_share(spark, sf_dir):
    return frames.share_above(_frames(spark, sf_dir), 120.0).select("item", F.round("share", 6).alias("share"), F.round("mean_high", 5).alias("mean_high"))


@_says(f"WITH {_F} SELECT item, CAST(floor(pos / 20) AS BIGINT) AS segment, round(quantile_cont(hz, 0.5), 6) AS median FROM f WHERE hz > 0 GROUP BY 1, 2")
def segment_medians(spark, sf_dir):
    return frames.segment_medians(_frames(spark, sf_dir), 20).withColumn("median", F.round("median", 6))


@_says(f"WITH {_F} SELECT item, CAST(CASE WHEN count(*) < 10 OR quantile_cont(hz, 0.99) <= 90 THEN 0 ELSE greatest(-12, -ceil(12 * log2(quantile_cont(hz, 0.99) / 90))) END AS INT) AS semis FROM f WHERE hz > 0 GROUP BY item")
def key_shift(spark, sf_dir):
    return frames.key_shift(_frames(spark, sf_dir), 90.0)


@_says(f"WITH {_STATS} SELECT item, CASE WHEN abs(1200 * log2(80.0 / median)) <= 800 THEN 0 ELSE CAST(round_even(log2(80.0 / median), 0) * 12 AS INT) END AS semis FROM s")
def octave_map(spark, sf_dir):
    return frames.pitch_stats(_frames(spark, sf_dir)).select("item", frames.octave_map(F.col("median"), F.lit(80.0)).alias("semis"))


@_says(f"WITH {_F} SELECT event_id, round(CASE WHEN hz > 0 THEN hz * pow(2.0, -0.25) ELSE hz END, 6) AS hz FROM f")
def shift_pitch(spark, sf_dir):
    return _frames(spark, sf_dir).select("event_id", F.round(frames.shift_pitch(F.col("hz"), -3), 6).alias("hz"))


@_says("SELECT user_id, round(CASE WHEN sqrt(avg(value * value)) < 1e-10 THEN -120.0 ELSE 20 * log10(sqrt(avg(value * value))) END, 6) AS level FROM events GROUP BY user_id")
def rms_level(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.round(frames.rms_dbfs(F.col("value")), 6).alias("level"))


@_says(f"""
    WITH {_F}, q AS (SELECT item, greatest(quantile_cont(value, 0.1) * 2, 1e-4) AS l FROM f GROUP BY item), m AS (SELECT item, pos, value > l AS loud FROM f JOIN q USING (item)),
    e AS (SELECT item, count(*) AS n, count(*) FILTER (WHERE loud) AS k, min(pos) FILTER (WHERE loud) AS a, max(pos) FILTER (WHERE loud) AS b FROM m GROUP BY item),
    r AS (SELECT item, avg(CASE WHEN loud THEN 0.0 ELSE 1.0 END) AS r FROM m JOIN e USING (item) WHERE pos BETWEEN a AND b GROUP BY item)
    SELECT item, round(CASE WHEN n < 4 OR k < 2 THEN 0.5 WHEN r BETWEEN 0.05 AND 0.20 THEN 1.0 WHEN r < 0.05 THEN r / 0.05 ELSE greatest(0.0, 1 - (r - 0.20) / 0.20) END, 6) AS score FROM e LEFT JOIN r USING (item)""")
def pause_score(spark, sf_dir):
    return frames.pause_score(_frames(spark, sf_dir), "value").withColumn("score", F.round("score", 6))


@_says(f"""
    WITH {_F}, s AS (SELECT item, pos, lag(pos, 2) OVER w AS p, (value - lag(value, 2) OVER w) / (pos - lag(pos, 2) OVER w) AS k FROM f WINDOW w AS (PARTITION BY item ORDER BY pos)),
    x AS (SELECT *, p IS NOT NULL AND abs(k) < 6 AND coalesce(lead(p IS NOT NULL AND abs(k) < 6) OVER (PARTITION BY item ORDER BY pos), false) AS hit FROM s)
    SELECT item, CASE WHEN count(*) >= 4 AND bool_or(hit) THEN min(pos) FILTER (WHERE hit) ELSE max(pos) END AS step, NOT (count(*) >= 4 AND bool_or(hit)) AS still_dropping FROM x GROUP BY item""")
def plateau_onset(spark, sf_dir):
    f = _frames(spark, sf_dir).select("item", F.col("pos").cast("bigint").alias("step"), F.col("value").alias("loss"))
    return frames.plateau_onset(f, 6.0)


@_says(f"""
    WITH {_F}, x AS (SELECT item, pos AS seq, event_type AS label, unnest(range(pos, pos + event_id % 4)) AS pos FROM f)
    SELECT item, pos, arg_max(label, seq) AS label FROM x GROUP BY item, pos""")
def frames_of_intervals(spark, sf_dir):
    f = _frames(spark, sf_dir).select("item", F.col("pos").cast("bigint").alias("seq"), F.col("pos").cast("bigint").alias("first"), (F.col("event_id") % 4).alias("length"), F.col("event_type").alias("label"))
    return frames.frames_of_intervals(f)


_PIECES = "p AS (SELECT user_id AS item, epoch_us(ts) / 3.6e9 AS start, epoch_us(ts) / 3.6e9 + value AS stop FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY start, stop) AS k FROM p)"


@_says(f"""
    WITH RECURSIVE {_PIECES}, r(item, k, last, taken, hit) AS (SELECT item, CAST(0 AS BIGINT), CAST(-1.0 AS DOUBLE), 0, false FROM n GROUP BY item
      UNION ALL SELECT n.item, n.k, CASE WHEN taken < 8 AND n.start >= last - 0.05 THEN n.stop ELSE last END, taken + CASE WHEN taken < 8 AND n.start >= last - 0.05 THEN 1 ELSE 0 END, taken < 8 AND n.start >= last - 0.05 FROM r JOIN n ON n.item = r.item AND n.k = r.k + 1)
    SELECT item, round(start, 6) AS start, round(stop, 6) AS stop FROM r JOIN n USING (item, k) WHERE hit""")
def pick_apart(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    p = _t(spark, sf_dir, "events").select(F.col("user_id").alias("item"), start.alias("start"), (start + F.col("value")).alias("end"))
    return frames.pick_apart(p, 8).select("item", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"))


@_says(f"""
    WITH RECURSIVE {_F}, w AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY pos) AS seq, pos + 0.3 AS at FROM f WHERE event_type = 'purchase'),
    t AS (SELECT item, CAST(pos AS DOUBLE) AS start FROM f WHERE event_type = 'view'),
    r(item, seq, used, start) AS (SELECT item, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST(NULL AS DOUBLE) FROM w GROUP BY item
      UNION ALL SELECT item, seq, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, b FROM (SELECT w.item, w.seq, r.used, (SELECT arg_min(t.start, struct_pack(a := abs(t.start - w.at), b := t.start)) FROM t WHERE t.item = w.item AND abs(t.start - w.at) <= 2.5 AND NOT list_contains(r.used, t.start)) AS b FROM r JOIN w ON w.item = r.item AND w.seq = r.seq + 1))
    SELECT item, seq, start FROM r WHERE start IS NOT NULL""")
def nearest_unused(spark, sf_dir):
    f = _frames(spark, sf_dir)
    seq = F.row_number().over(Window.partitionBy("item").orderBy("pos")).cast("bigint")
    wanted = f.filter("event_type = 'purchase'").select("item", seq.alias("seq"), (F.col("pos") + 0.3).alias("at"))
    return frames.nearest_unused(wanted, f.filter("event_type = 'view'").select("item", F.col("pos").cast("double").alias("start")), 2.5)


# Scripts

_SENT = f"""l0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{text.SENTENCE}') AS s FROM documents),
  l1 AS (SELECT doc_id, list_filter(list_transform(s, lambda x: regexp_replace(x, '{OUTER_SPACE}', '', 'g')), lambda x: regexp_matches(x, '{text.WORDED}')) AS s FROM l0),
  l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM l1)"""
_HITS = {e: " + ".join(f"contains(line, '{w}')::INT" for w in ws) for e, ws in scripts.EMOTION_WORDS.items()}
_EMO = f"""h AS (SELECT *, {", ".join(f"{v} AS h_{e}" for e, v in _HITS.items())} FROM l), b AS (SELECT *, greatest({", ".join(f"h_{e}" for e in _HITS)}) AS best, regexp_matches(line, '[！!]') AS sh, regexp_matches(line, '[？?]') AS qu, contains(line, '…') AS tr FROM h),
  k AS (SELECT *, CASE WHEN best = 0 THEN 'calm' {" ".join(f"WHEN h_{e} = best THEN '{e}'" for e in scripts.EMOTIONS if e in _HITS)} END AS k0, CASE WHEN best = 0 THEN 0.35 ELSE least(0.9, 0.5 + 0.15 * best) END AS s0 FROM b),
  g AS (SELECT doc_id, pos, line, CASE WHEN k0 = 'calm' AND sh THEN 'happy' WHEN k0 = 'calm' AND qu THEN 'surprised' WHEN k0 = 'calm' AND tr THEN 'melancholic' ELSE k0 END AS emotion,
    round(CASE WHEN sh THEN least(0.95, s0 + 0.15) WHEN k0 = 'calm' AND qu THEN greatest(s0, 0.5) WHEN k0 = 'calm' AND tr THEN 0.45 ELSE s0 END, 2) AS intensity FROM k)"""
_BASE = "CASE " + " ".join(f"WHEN regexp_matches(right(line, 3), '[{m}]') THEN {v}" for m, v in scripts.PAUSES) + " ELSE 240 END"
_FACTOR = "CASE emotion " + " ".join(f"WHEN '{e}' THEN {v}" for e, v in scripts.PAUSE_FACTORS.items()) + " ELSE 1.0 END"
_LO = "CASE " + " ".join(f"WHEN suffix(line, '{m}') THEN {lo}" for m, lo, _ in scripts.BANDS) + " ELSE 320 END"
_HI = "CASE " + " ".join(f"WHEN suffix(line, '{m}') THEN {hi}" for m, _, hi in scripts.BANDS) + " ELSE 450 END"
_JIT = "(0.85 + 0.30 * (CAST('0x' || substr(md5('0:' || doc_id || ':' || pos), 1, 7) AS BIGINT) / 268435456.0))"


@_says(f"WITH {_SENT} SELECT doc_id, count(*) AS n, max(length(line)) AS longest, md5(string_agg(line, '|' ORDER BY pos)) AS digest FROM l GROUP BY doc_id")
def script_sentences(spark, sf_dir):
    told = lambda s: F.struct(F.size(s).cast("bigint").alias("n"), F.array_max(F.transform(s, F.char_length)).cast("bigint").alias("longest"), F.md5(F.array_join(s, "|")).alias("digest"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.transform(F.array(text.sentences(F.col("text"))), told)).alias("s"))
    return docs.filter("s.n > 0").select("doc_id", "s.*")  # behind the explode, so that the filter doesn't split once more


@_says(f"WITH {_SENT}, {_EMO} SELECT doc_id, pos, emotion, CAST(intensity AS DOUBLE) AS intensity FROM g")
def lexicon_label(spark, sf_dir):
    s = scripts.rules_script(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "emotion", "intensity")


@_says(f"WITH {_SENT}, {_EMO} SELECT doc_id, pos, CAST(floor(greatest(greatest(80.0, {_LO}), least(least(2000.0, {_HI}), {_BASE} * CAST({_FACTOR} AS DOUBLE) * {_JIT}))) AS INT) AS pause FROM g")
def script_pauses(spark, sf_dir):
    return scripts.rules_script(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "pause")


@_says(f"WITH {_SENT} SELECT doc_id, pos, CASE WHEN contains('{scripts.FINAL_MARKS}', right(line, 1)) THEN greatest(greatest(80, {_LO}), 260) ELSE 0 END AS least FROM l")
def least_pauses(spark, sf_dir):
    s = scripts.rules_script(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), scripts.least_pause(F.col("line")).alias("least"))


@_says(f"""
    WITH RECURSIVE {_SENT}, {_EMO}, x AS (SELECT doc_id, pos, line, emotion, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM g),
    r(doc_id, pos, first, n, emotion, tokens, chars, tail) AS (SELECT doc_id, pos, pos, CAST(1 AS BIGINT), emotion, tokens, length(line), right(line, 1) FROM x WHERE pos = 0
      UNION ALL SELECT x.doc_id, x.pos, CASE WHEN j THEN first ELSE x.pos END, CASE WHEN j THEN n + 1 ELSE 1 END, x.emotion, CASE WHEN j THEN r.tokens + x.tokens ELSE x.tokens END,
        CASE WHEN j THEN chars + length(line) + CASE WHEN contains('{scripts.CLOSED}', tail) THEN 0 ELSE 1 END ELSE length(line) END, right(line, 1)
        FROM (SELECT x.*, r.first, r.n, r.tokens AS rt, r.chars, r.tail, r.emotion = x.emotion AND r.tokens + x.tokens <= 120 AND r.chars + length(x.line) + 1 <= 40 AND r.tail NOT IN ('…', '—') AS j, r.tokens AS tokens_1 FROM r JOIN x ON x.doc_id = r.doc_id AND x.pos = r.pos + 1) x, LATERAL (SELECT x.rt AS tokens) r)
    SELECT doc_id, first, max(n) AS n, CAST(max(tokens) AS BIGINT) AS tokens, CAST(max(chars) AS BIGINT) AS chars FROM r GROUP BY doc_id, first""")
def block_merge(spark, sf_dir):
    s = scripts.rules_script(_t(spark, sf_dir, "documents"), "doc_id", "text").withColumn("tokens", F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")))
    return scripts.merge_blocks(s, "doc_id", "pos")


# Catalogs

_KIND = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"


@_says(f"""
    WITH p AS (SELECT split_part(url, '?', 1) AS path, min(page_id) AS ord FROM pages GROUP BY 1), h AS (SELECT DISTINCT split_part(url, '?', 1) AS path FROM pages WHERE contains(html, '<table'))
    SELECT path, ord, CASE WHEN path NOT IN (SELECT path FROM h) THEN 'missing' WHEN {_KIND} NOT IN ('html', 'org', 'net') THEN 'skipped' ELSE 'kept' END AS verdict FROM p""")
def collect_inputs(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").withColumn("path", F.split_part("url", F.lit("?"), F.lit(1)))
    return catalog.collect_inputs(pages.select("path", F.col("page_id").alias("ord")), pages.filter(F.col("html").contains("<table")).select("path"), ("html", "org", "net"))


@_says("""
    WITH p AS (SELECT list_filter(string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/'), lambda x: x <> '') AS p FROM pages)
    SELECT p[-1] AS name, CASE WHEN len(p) >= 2 THEN p[-2] END AS lang, count(*) AS n FROM p GROUP BY 1, 2""")
def path_partitions(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select(*catalog.path_parts(F.col("url"), {"name": 1, "lang": 2})).groupBy("name", "lang").agg(F.count(F.lit(1)).alias("n"))


@_says("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_on_disk(spark, sf_dir):
    return catalog.without(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


@_says("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def delete_by_ids(spark, sf_dir):
    left = catalog.without(_t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), _t(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@_says("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def feature_lookup(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("_here"))
    return _t(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", F.col("_here").isNull().alias("missing"))


@_says("SELECT lang, string_agg(source, '+' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def reverse_lookup(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("lang", "source").distinct().groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), "+").alias("sources"))


@_says("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS root, sum(length(html))::BIGINT AS bytes, count(*) AS files, max(page_id) AS newest FROM pages GROUP BY 1")
def folder_stats(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("url", F.char_length("html").cast("bigint").alias("size"), "page_id")
    return catalog.folder_stats(pages, F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), "size", "page_id")


@_says("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-' || o_orderstatus AS name, epoch(o_orderdate)::BIGINT AS started FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey")
def run_catalog(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    named = o.select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), "o_orderstatus").alias("name"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("started"))
    return named.orderBy(F.desc("started"), "o_orderkey")


@_says("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k <= 3")
def checkpoint_retention(spark, sf_dir):
    return catalog.keep_best(_t(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 3).select("o_custkey", "o_orderkey")


@_says("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, CASE WHEN l_discount > 0 THEN l_discount END NULLS LAST, l_linenumber) AS place FROM lineitem")
def candidate_ranks(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("val", F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(F.lit(float("nan"))))
    return catalog.ranked_candidates(rows, "l_orderkey", "l_quantity", "val", "l_linenumber").select("l_orderkey", "l_linenumber", "place")


@_says("SELECT o_custkey, round(1 - min(o_totalprice) / arg_min(o_totalprice, o_orderkey), 6) AS improved FROM orders GROUP BY o_custkey")
def run_improvement(spark, sf_dir):
    return catalog.improvement(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", F.round("improved", 6).alias("improved"))


@_says("SELECT lang AS kind, count(*) AS n, sum(n_chars)::BIGINT AS bytes, coalesce(sum(n_chars) FILTER (WHERE n_chars < 500), 0)::BIGINT AS deletable_bytes FROM documents GROUP BY ROLLUP (lang)")
def artifact_totals(spark, sf_dir):
    return catalog.totals_by_kind(_t(spark, sf_dir, "documents").withColumnRenamed("lang", "kind"), "kind", "n_chars", F.col("n_chars") < 500)


@_says("SELECT regexp_replace(p_brand, '[0-9]+', 'N') || '/' || p_type AS pattern, count(*) AS n, sum(p_size)::BIGINT AS total, list_sort(list(p_name ORDER BY p_name)[1:2])::VARCHAR AS examples FROM part GROUP BY 1")
def layer_groups(spark, sf_dir):
    pattern = F.concat(F.regexp_replace("p_brand", "[0-9]+", "N"), F.lit("/"), "p_type")
    g = catalog.grouped_layers(_t(spark, sf_dir, "part"), pattern, "p_name", "p_size")
    return g.select("pattern", "n", "total", F.concat(F.lit("["), F.array_join("examples", ", "), F.lit("]")).alias("examples"))


@_says("""
    WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, sum((x - 0.01) * (x - 0.01)) AS d, sum(x * x) AS w FROM x GROUP BY label)
    SELECT label, round(sqrt(sum(d)) / sqrt(sum(w)), 6) AS drift FROM s GROUP BY ROLLUP (label)""")
def weight_drift(spark, sf_dir):
    x = _t(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("w")).withColumn("w", F.col("w").cast("double"))
    return catalog.norm_drift(x.withColumn("d", F.col("w") - 0.01), "label", "d", "w").withColumn("drift", F.round("drift", 6))


@_says("SELECT DISTINCT p_type AS pattern FROM part WHERE (p_type LIKE '%O%' OR p_type = 'STANDARD') AND p_type <> 'PROMO'")
def pattern_resolution(spark, sf_dir):
    wanted = spark.createDataFrame([("*O*",), ("STANDARD",), ("no.such*",)], "want string")
    dead = spark.createDataFrame([("PROMO",)], "pattern string")
    return catalog.resolve_patterns(wanted, _t(spark, sf_dir, "part").select(F.col("p_type").alias("pattern")), dead)


@_says("""
    WITH v AS (SELECT event_id, (event_id % 4) || '.' || (event_id % 13) || '.x' AS got FROM events)
    SELECT event_id, event_id % 4 > 2 OR (event_id % 4 = 2 AND event_id % 13 >= 5) AS newer, starts_with(got, '1.2.') AS line FROM v""")
def version_match(spark, sf_dir):
    got = F.concat_ws(".", (F.col("event_id") % 4).cast("string"), (F.col("event_id") % 13).cast("string"), F.lit("x"))
    return _t(spark, sf_dir, "events").select("event_id", catalog.version_fits(got, ">=2.5").alias("newer"), catalog.version_fits(got, "1.2..*").alias("line"))


# Samples

_PAIRS = "p AS (SELECT doc_id, lang, source, n_chars / 100.0 AS margin FROM documents), e AS (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"


@_says(f"""
    WITH {_PAIRS}, f AS (SELECT lang, source, min(doc_id) AS doc_id FROM p WHERE margin >= 8 AND (lang, source) NOT IN (SELECT (lang, source) FROM e) GROUP BY lang, source)
    SELECT CASE WHEN p.lang IS NULL OR p.source IS NULL THEN 'missing' WHEN margin < 8 THEN 'margin' WHEN f.doc_id IS NULL OR f.doc_id <> p.doc_id THEN 'duplicate' ELSE 'imported' END AS verdict, count(*) AS n FROM p LEFT JOIN f ON p.lang = f.lang AND p.source = f.source GROUP BY 1""")
def import_pairs(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    known = docs.join(_t(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("lang", "source")
    pairs = docs.select("doc_id", "lang", "source", (F.col("n_chars") / 100).alias("margin"))
    return sampling.import_verdicts(pairs, known, ["lang", "source"], "margin", 8.0, ["doc_id"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@_says("SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def append_pairs(spark, sf_dir):
    new = _t(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("toxic"))
    return sampling.append_new(_t(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", "toxic"), new, "doc_id")


@_says("SELECT doc_id FROM documents ORDER BY length(trim(coalesce(text, ''))), n_chars NULLS LAST, doc_id LIMIT 12")
def shortest_samples(spark, sf_dir):
    return sampling.shortest(_t(spark, sf_dir, "documents"), "text", "n_chars", "doc_id", 12).select("doc_id")


@_says("SELECT n_chars BETWEEN 2 AND 3000 AND length(text) BETWEEN 1 AND 2500 AS kept, count(*) AS n FROM documents GROUP BY 1")
def usable_ids(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("n_chars", F.char_length("text").alias("chars"))
    return sampling.usable(docs, "n_chars", "chars", 3000, 2500).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@_says("""
    WITH c AS (SELECT (SELECT count(*) FROM labels) AS t, (SELECT count(*) FROM documents) AS p), k AS (SELECT p, CAST(round_even(t * 0.8 / 0.2, 0) AS BIGINT) AS need FROM c),
    h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents)
    SELECT 'target' AS kind, doc_id, 1 AS copies FROM labels UNION ALL SELECT 'replay', doc_id, CAST(need // p + CASE WHEN r <= need % p THEN 1 ELSE 0 END AS INT) FROM h, k WHERE need // p + CASE WHEN r <= need % p THEN 1 ELSE 0 END > 0""")
def epoch_mix(spark, sf_dir):
    return sampling.epoch_mix(_t(spark, sf_dir, "labels").select("doc_id"), _t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.8)


@_says("SELECT doc_id, doc_id % 64 AS shard, (row_number() OVER (PARTITION BY doc_id % 64 ORDER BY n_chars, doc_id) - 1) // 8 AS batch FROM documents")
def batch_plan(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 64).alias("shard"))
    return sampling.batch_plan(docs, "shard", "n_chars", "doc_id", 8).select("doc_id", "shard", "batch")


@_says("""
    WITH p AS (SELECT conv_id, turn AS prompt, length(text) AS f FROM conversations WHERE role = 'user'), t AS (SELECT conv_id, turn AS target, length(text) AS f FROM conversations WHERE role <> 'user')
    SELECT conv_id, prompt, target, CAST(least(t.f, 600 - p.f) AS INT) AS frames FROM p JOIN t USING (conv_id) WHERE least(t.f, 600 - p.f) >= 50""")
def truncated_pairs(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("frames"), (F.col("role") == "user").alias("asks"))
    return sampling.truncated_pairs(c.filter("asks").select("conv_id", F.col("turn").alias("prompt"), "frames"), c.filter("not asks").select("conv_id", F.col("turn").alias("target"), "frames"), "conv_id", 600, 50)


@_says("""
    WITH s AS (SELECT source, sum(n_chars) / 50000.0 AS m, count(*) AS n FROM documents GROUP BY source)
    SELECT source, CASE WHEN m < 5 THEN 'conservative,balanced' WHEN m < 8 THEN 'balanced,expressive,conservative' WHEN m < 30 THEN 'expressive,balanced,aggressive' ELSE 'expressive,aggressive,balanced' END AS ladder, CAST(greatest(1, n // 4) AS INT) AS every FROM s""")
def preset_ladder(spark, sf_dir):
    s = _t(spark, sf_dir, "documents").groupBy("source").agg((F.sum("n_chars") / 50000).alias("m"), F.count(F.lit(1)).alias("n"))
    return s.select("source", F.array_join(sampling.preset_ladder(F.col("m")), ",").alias("ladder"), sampling.eval_every(F.col("n"), 3).alias("every"))


@_says("""
    WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM events GROUP BY user_id)
    SELECT user_id, round(lo + (hi - lo) * (CAST('0x' || substr(md5('3:' || user_id), 1, 7) AS BIGINT) / 268435456.0), 6) AS target FROM q""")
def band_samples(spark, sf_dir):
    q = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.percentile("value", F.lit(0.25)).alias("lo"), F.percentile("value", F.lit(0.75)).alias("hi"))
    return q.select("user_id", F.round(sampling.band_sample(F.col("lo"), F.col("hi"), F.col("user_id"), 3), 6).alias("target"))


@_says("SELECT vec_id, list_sum(embedding::DOUBLE[])::DOUBLE IS NOT NULL AS whole, 80 AS width, greatest(0, 80 - len(embedding))::INT AS filled FROM embeddings")
def padded_vectors(spark, sf_dir):
    wide = sampling.padded(F.col("embedding"), F.lit(80), 0.0)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").isNotNull().alias("whole"), F.size(wide).alias("width"), (F.size(wide) - F.size("embedding")).alias("filled"))


@_says("SELECT user_id, sha256(sha256('|' || a) || '|' || b) AS chain FROM (SELECT user_id, min(event_type) AS a, max(event_type) AS b FROM events GROUP BY user_id)")
def hash_chains(spark, sf_dir):
    ends = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array(F.min("event_type"), F.max("event_type")).alias("parts"))
    return ends.select("user_id", sampling.hash_chain(F.col("parts")).alias("chain"))


@_says("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang")
def corpus_coverage(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    every = docs.agg(F.count(F.lit(1)).alias("_all"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources")).join(F.broadcast(every)).select("lang", "n", "sources", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


@_says("""
    SELECT o_orderpriority, round(avg(date_diff('day', o_orderdate, l_shipdate)), 6) AS days, count(*) FILTER (WHERE l_shipdate < o_orderdate + INTERVAL 30 DAY) AS in_month, max(date_trunc('quarter', l_shipdate))::DATE::VARCHAR AS last_quarter
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def date_arithmetic(spark, sf_dir):
    both = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    early = F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 30 days")
    return both.groupBy("o_orderpriority").agg(F.round(F.avg(F.date_diff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))), 6).alias("days"), F.count_if(early).alias("in_month"), F.max(F.trunc(F.col("l_shipdate").cast("date"), "quarter")).cast("string").alias("last_quarter"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
