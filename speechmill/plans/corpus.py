"""The corpus operators as queries over the driver's tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import scans, ranked, records, series


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _norm(column: str) -> str:
    return f"lower(regexp_replace(translate(coalesce({column}, ''), '{text.FULL_WIDTH}', '{text.HALF_WIDTH}'), {_lit(text.COMPARE_MARKS)}, '', 'g'))"


#: What SQL strips, as a pattern of its own.
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
OUTER_SPACE = f"^{_SPACE}|{_SPACE}$"
_STRIP = f"regexp_replace(coalesce(text, ''), {_lit(OUTER_SPACE)}, '', 'g')"
_CORE = f"regexp_replace({_STRIP}, {_lit(text.VERDICT_MARKS)}, '', 'g')"
_STOCK = " OR ".join(f"contains(lower(text), '{p}')" for p in text.STOCK_PHRASES)
_REASON = f"""CASE WHEN {_STRIP} = '' THEN 'empty' WHEN len(core) < 2 THEN 'too_short' WHEN len(cs) = 1 THEN 'single_character'
  WHEN list_max(list_transform(cs, lambda c: len(core) - len(replace(core, c, '')))) / len(core) >= 0.5 THEN 'one_character_dominates'
  WHEN len(core) >= 8 AND len(cs) / len(core) < 0.15 THEN 'few_characters' WHEN {_STOCK} THEN 'stock_phrase' ELSE '' END"""
_REASONED = f"SELECT *, {_REASON} AS reason FROM (SELECT *, list_distinct(string_split(core, '')) AS cs FROM (SELECT *, {_CORE} AS core FROM documents))"


def curate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each drop reason takes; at most two with the same words stay."""
    docs = text.with_degenerate_reason(_t(spark, sf_dir, "documents"), "text", "reason")
    key = F.lower(F.array_join(F.filter(F.split("text", r"\s+"), lambda w: w != ""), " "))
    kept = records.curate(docs, F.col("reason"), F.col("n_chars"), 20, key, ["doc_id"], 2)
    return kept.groupBy(F.get(F.split("drop_reason", " "), F.lit(0)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def doc_status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by status, taking fifteen characters for a second and a label for features."""
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id", "left")
    first, problems = records.status(F.col("text"), F.col("n_chars") / 15.0, F.when(F.col("q") == 0, 10.0).otherwise(30.0), F.col("q").isNotNull(), True)
    return docs.select(first.alias("status"), F.size(problems).alias("k"), "n_chars").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("bigint").alias("problems"), F.round(F.sum(F.col("n_chars") / 15.0) / 60, 3).alias("minutes"))


def text_normalize_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


def cer_adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate between each user turn and the assistant's answer."""
    turns = _t(spark, sf_dir, "conversations")
    a = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    b = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.error_rate(F.col("ref"), F.col("hyp")), 6).alias("cer"))


def sanitize_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.sanitize_punctuation(F.col("text")).alias("clean"))


def sentence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(text.sentences(F.col("text"))).alias("pos", "sentence")).filter("pos is not null")  # an inner one asks for the size first, and so splits twice more
    return done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("sentence")).alias("longest"), F.sum(F.char_length("sentence")).alias("total"))


def repeat_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text")).alias("k"))
    return records.keep_repeats(docs, F.col("k"), ["doc_id"], 1).select("doc_id", "over")


def only_new_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come in again are taken once, and not if a labelled document has them."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"))
    return records.only_new(docs, docs.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), ["k"], ["doc_id"]).select("doc_id")


def upsert_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("source"), F.lit(1).alias("unknown"))
    return records.update_fields(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), changes, "doc_id")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.split_rows(_t(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], F.col("doc_id"), 0.05, 1).select("doc_id", "source", "part")


def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a conversation on one side."""
    turns = _t(spark, sf_dir, "conversations").withColumn("side", F.when(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 1) < "2", "val").otherwise("train"))
    return turns.groupBy("side").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"))


def holdout_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.highest_share(_t(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value", "event_id").filter("held_out").select("event_id", "event_type")


def balance_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.balance_copies(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def ab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contenders: mean value of a user's views and of their clicks."""
    ev = _t(spark, sf_dir, "events")
    side = lambda kind: ev.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    return ranked.compare(side("view"), side("click"), "user_id", "v", 5.0)


def reward_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    score = ranked.weighted_score([(F.least(F.lit(1.0), F.col("n_chars") / 4000.0), 0.5), (F.col("quality").cast("double"), 0.3), (1.0 - F.col("toxic"), 0.2)])
    return docs.select("doc_id", F.round(score, 6).alias("reward"))


def fingerprint_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.loudness_figures(_t(spark, sf_dir, "events"), "user_id", "value", target=50.0, digits=6)


def topk_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.top_per_group(_t(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "place")


def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events").withColumns({"reward": F.col("value") / 100, "creak": F.pmod("event_id", F.lit(10)) / 10})
    return ranked.best_of(ev, "user_id", "reward", "event_id", "creak").select("user_id", "event_id")


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.preference_pairs(_t(spark, sf_dir, "events"), "user_id", "value", "event_id", 50.0).select("user_id", "chosen", "rejected", F.round("margin", 6).alias("margin"))


def pick_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    asked = ev.select("user_id").distinct().withColumn("event_type", F.explode(F.array(F.lit("purchase"), F.lit("signup"), F.lit("error"))))
    return records.pick_with_fallback(asked, ev, "user_id", "event_type", ["value", "event_id"], "error", ["event_id"])


def have_missing_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    have = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("have"))
    return have.select("user_id", F.array_join("have", ",").alias("have"), F.array_join(F.array_except(kinds, "have"), ",").alias("missing"))


def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one kind, less than a day apart, as intervals in seconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ev = _t(spark, sf_dir, "events").select("user_id", "event_type", at.alias("s"), at.alias("e"))
    return series.merge_adjacent(ev, "user_id", "s", "e", "event_type", 86400.0)


def quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.quiet_runs(_t(spark, sf_dir, "events"), "user_id", "event_id", "value", 40.0, 2)


def step_limited_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return scans.step_limited(ev, "user_id", ["event_id"], "value", 2.5, 50.0).select("user_id", "pos", F.col("smooth").alias("value"))


def early_stop_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return scans.early_stops(ev, "user_id", ["event_id"], "value", 3, 1e-4).withColumns({"best_at": F.col("best_at").cast("int"), "stopped_at": F.col("stopped_at").cast("int")})


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = text.pack_greedily(text.split_after_marks(F.col("text")), 40)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(packed).alias("pos", "segment"))


def nms_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ev = _t(spark, sf_dir, "events").select("user_id", "event_id", at.alias("s"), (at + F.col("value") * 20_000).alias("e"), "value")
    return series.suppress_overlaps(ev, "user_id", "s", "e", "value", 0.6, 20).select("user_id", "event_id")


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest class mean by cosine; the means are one row for each class, carried as an array."""
    vec = _t(spark, sf_dir, "embeddings")
    mean = vec.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    classes, block = mean.count(), 4096
    # Classes go to the vectors a block at a time, and a vector keeps the best of each block: blocks bound the broadcast.
    best = None
    blocks = -(-classes // block)
    for b in range(blocks):
        part = mean.filter(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b).agg(F.collect_list(F.struct("label", "c")).alias("_classes"))
        near = F.array_max(F.transform("_classes", lambda m: F.struct(F.round(numeric.cosine(F.col("embedding"), m["c"]), 9).alias("sim"), (-m["label"]).alias("l"))))
        one = vec.join(F.broadcast(part)).select("vec_id", near.alias("n"))
        best = one if best is None else best.unionByName(one)
    if best is None:
        return vec.limit(0).select("vec_id", F.col("label").alias("nearest"), F.lit(0.0).alias("similarity"))
    if blocks > 1:
        best = best.groupBy("vec_id").agg(F.max("n").alias("n"))
    return best.select("vec_id", (-F.col("n.l")).alias("nearest"), F.round("n.sim", 5).alias("similarity"))


def substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [r[0] for r in _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().orderBy("w").limit(records.MOST_NAMES + 1).collect()]  # one more than allowed, so that contained_name refuses
    return records.contained_name(_t(spark, sf_dir, "part"), "p_type", [w.upper() for w in words if w]).select("p_partkey", "match")


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the value of the user's last view."""
    ev = _t(spark, sf_dir, "events")
    left = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("view_value")).withColumnRenamed("ts", "at")
    return series.as_of(left, right, ["user_id"], "ts", "at", "view_value").select("event_id", "view_value")


def stable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", numeric.stable_seed(42, F.col("doc_id")).alias("seed"))


def size_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", numeric.human_size(F.octet_length("text") * 37).alias("size"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by kind, as a stream over the table's files would give them."""
    from ..streaming import windows

    return windows.hourly_counts(_t(spark, sf_dir, "events"))


ORACLES = {
    "curate_documents": f"""
        WITH r AS ({_REASONED}),
        a AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), ' ') AS k, CASE WHEN reason <> '' THEN 'text:' WHEN n_chars < 20 THEN 'score' ELSE '' END AS reason FROM r),
        b AS (SELECT CASE WHEN reason = '' AND row_number() OVER (PARTITION BY k, reason = '' ORDER BY doc_id) > 2 THEN 'repeats' ELSE reason END AS reason FROM a)
        SELECT reason, count(*) AS n FROM b GROUP BY reason""",
    "doc_status_stats": f"""
        WITH d AS (SELECT text, n_chars / 15.0 AS s, q FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)),
        e AS (SELECT s, CASE WHEN {_STRIP} = '' THEN 'no_text' WHEN s > 72.6 THEN 'over_hard_limit' WHEN s > 20 THEN 'too_long' WHEN s < 1 THEN 'too_short' WHEN q = 0 THEN 'low_snr' WHEN q IS NULL THEN 'no_features' ELSE 'ready' END AS status,
          ({_STRIP} = '')::INT + (s > 20)::INT + (s < 1)::INT + coalesce(q = 0, false)::INT + (q IS NULL)::INT AS k FROM d)
        SELECT status, count(*) AS n, CAST(sum(k) AS BIGINT) AS problems, round(sum(s) / 60, 3) AS minutes FROM e GROUP BY status""",
    "sentence_explode": f"""
        WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{text.SENTENCE}'), lambda x: regexp_replace(x, '{OUTER_SPACE}', '', 'g')), lambda x: regexp_matches(x, '{text.WORDED}')) AS s FROM documents)
        SELECT doc_id, len(s) AS n, CAST(list_max(list_transform(s, lambda x: length(x))) AS INT) AS longest, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS total FROM l WHERE len(s) > 0""",
    "text_normalize_compare": f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents",
    "repeat_cap": "SELECT doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) > 1 AS over FROM documents",
    "only_new_sources": "SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY text",
    "upsert_fields": "SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'toxic' ELSE source END AS source FROM documents LEFT JOIN labels USING (doc_id)",
    "split_rows": """
        SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= least(greatest(1, CAST(round_even(n * 0.05, 0) AS INT)), greatest(n - 1, 0)) THEN 'val' ELSE 'train' END AS part
        FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM documents)""",
    "split_groups": "SELECT CASE WHEN md5(CAST(conv_id AS VARCHAR))[1] < '2' THEN 'val' ELSE 'train' END AS side, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1",
    "holdout_highest": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= greatest(1, floor(n * 0.1))",
    "balance_copies": """
        WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS m FROM c)
        SELECT lang, n * (1 + least(3, greatest(0, CAST(round_even(m / n, 0) AS INT) - 1))) AS n FROM c, m""",
    "ab_summary": """
        WITH s AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY user_id, event_type), p AS (SELECT a.v AS a, b.v AS b, b.v - a.v AS d FROM s a JOIN s b USING (user_id) WHERE a.event_type = 'view' AND b.event_type = 'click')
        SELECT count(*) AS n, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b, round(avg(d), 4) AS mean_delta, count(*) FILTER (WHERE d > 5) AS wins, count(*) FILTER (WHERE d < -5) AS losses, count(*) FILTER (WHERE abs(d) <= 5) AS ties FROM p""",
    "reward_weighted": "SELECT doc_id, round((0.5 * least(1.0, n_chars / 4000.0) + coalesce(0.3 * quality, 0) + coalesce(0.2 * (1 - toxic), 0)) / (CASE WHEN quality IS NULL THEN 0.5 ELSE 1.0 END), 6) AS reward FROM documents LEFT JOIN labels USING (doc_id)",
    "fingerprint_by_user": """
        SELECT user_id, n, round(q[1], 6) AS p10, round(q[2], 6) AS p25, round(q[3], 6) AS median, round(q[4], 6) AS p75, round(q[5], 6) AS p90, round(s, 6) AS std, round(least(greatest(50.0 - q[3], -15.0), 12.0), 6) AS gain
        FROM (SELECT user_id, count(*) AS n, quantile_cont(CAST(value AS DOUBLE), [0.1, 0.25, 0.5, 0.75, 0.9]) AS q, stddev_pop(value) AS s FROM events WHERE value > -100 GROUP BY user_id) WHERE n >= 3""",
    "topk_by_group": "SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 3",
    "best_of_n": """
        WITH e AS (SELECT user_id, event_id, value / 100 AS r, CASE WHEN (event_id % 10) / 10 >= 0.5 THEN (event_id % 10) / 10 ELSE 0 END AS c FROM events WHERE value >= 0),
        t AS (SELECT *, max(r) OVER (PARTITION BY user_id) AS b FROM e)
        SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c, r DESC, event_id) AS k FROM t WHERE r >= b - 0.10) WHERE k = 1""",
    "preference_pairs": """
        WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS w FROM events WHERE value >= 0)
        SELECT x.user_id, x.event_id AS chosen, y.event_id AS rejected, round(x.value - y.value, 6) AS margin FROM e x JOIN e y ON x.user_id = y.user_id WHERE x.b = 1 AND y.w = 1 AND x.value - y.value >= 50 AND x.event_id <> y.event_id""",
    "pick_with_fallback": """
        WITH a AS (SELECT DISTINCT user_id, k AS event_type FROM events, (VALUES ('purchase'), ('signup'), ('error')) v(k)),
        r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS x, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS y FROM events)
        SELECT a.user_id, a.event_type, coalesce(e.event_id, CASE WHEN a.event_type <> 'error' THEN f.event_id END) AS event_id FROM a LEFT JOIN r e ON e.user_id = a.user_id AND e.event_type = a.event_type AND e.x = 1 LEFT JOIN r f ON f.user_id = a.user_id AND f.y = 1""",
    "have_missing_sets": """
        SELECT user_id, array_to_string(list_sort(h), ',') AS have, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda k: NOT list_contains(h, k)), ',') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS h FROM events GROUP BY user_id)""",
    "merge_adjacent": """
        WITH e AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events),
        m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND t - lag(t) OVER w < 86400 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_type)),
        r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_type ROWS UNBOUNDED PRECEDING) AS k FROM m)
        SELECT user_id, event_type, min(t) AS s, max(t) AS e, count(*) AS n FROM r GROUP BY user_id, event_type, k""",
    "quiet_runs": """
        WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), q AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS k FROM p WHERE value < 40)
        SELECT user_id, min(p) AS first, count(*) AS length FROM q GROUP BY user_id, k HAVING count(*) >= 2""",
    "step_limited_smooth": """
        WITH RECURSIVE p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
        r(user_id, pos, value) AS (SELECT user_id, pos, CAST(50.0 AS DOUBLE) FROM p WHERE pos = 0 UNION ALL SELECT p.user_id, p.pos, least(greatest(p.value, r.value - 2.5), r.value + 2.5) FROM r JOIN p ON p.user_id = r.user_id AND p.pos = r.pos + 1)
        SELECT user_id, CAST(pos AS INT) AS pos, value FROM r""",
    "early_stop_fold": """
        WITH RECURSIVE v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at_, value FROM events),
        s AS (SELECT user_id, at_, value AS best, 0::BIGINT AS best_at, 0 AS bad, NULL::BIGINT AS stopped FROM v WHERE at_ = 0 UNION ALL
          SELECT user_id, at_, best, best_at, bad, CASE WHEN bad >= 3 THEN at_ END FROM (SELECT v.user_id, v.at_, CASE WHEN v.value < s.best - 1e-4 THEN v.value ELSE s.best END AS best,
            CASE WHEN v.value < s.best - 1e-4 THEN v.at_ ELSE s.best_at END AS best_at, CASE WHEN v.value < s.best - 1e-4 THEN 0 ELSE s.bad + 1 END AS bad
            FROM s JOIN v ON v.user_id = s.user_id AND v.at_ = s.at_ + 1 WHERE s.stopped IS NULL))
        SELECT user_id, arg_max(best, at_) AS best, arg_max(best_at, at_)::INT AS best_at, max(stopped)::INT AS stopped_at FROM s GROUP BY user_id""",
    "nearest_centroid": """
        WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
        s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS sim FROM (SELECT vec_id, embedding FROM embeddings), c)
        SELECT vec_id, label AS nearest, round(sim, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS k FROM s) WHERE k = 1""",
    "substring_join": """
        WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT p_partkey, (SELECT upper(min(w)) FROM w WHERE w <> '' AND contains(p_type, upper(w))) AS match FROM part""",
    "as_of_join": """
        SELECT p.event_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "size_names": """
        SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size FROM (SELECT doc_id, CAST(strlen(text) * 37 AS DOUBLE) AS b FROM documents)""",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        curate_documents, doc_status_stats, text_normalize_compare, cer_adjacent_turns, sanitize_punct, sentence_explode, repeat_cap, only_new_sources, upsert_fields, split_rows, split_groups, holdout_highest, balance_copies,
        ab_summary, reward_weighted, fingerprint_by_user, topk_by_group, best_of_n, preference_pairs, pick_with_fallback, have_missing_sets, merge_adjacent, quiet_runs, step_limited_smooth, early_stop_fold, greedy_pack,
        nms_segments, nearest_centroid, substring_join, as_of_join, stable_seeds, size_names, event_windows,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
