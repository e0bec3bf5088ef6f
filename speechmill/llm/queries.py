"""The numbered operators as queries over whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontam, divergence, fingerprint, html, linedup, minhash, neighbours, ngram_lm, ranking, rollup, sharding
from .common import shared_dir, table

#: op7's file of ranks; None: the installed one.
RANKS: str | None = None


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"), scanned=True)


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ranking.train(docs, table(spark, sf_dir, "labels"))
    scored = ranking.score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(ranking.remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


TOKENIZERS = {
    "white-1": r"[^\x20\x09-\x0D]+",
    "alnum-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
}


def change_feed(docs: DataFrame) -> list[tuple[str, DataFrame]]:
    """Four batches that replay how the table may have come about; all rows take part.

    First most documents come, some of them in an older form; then the others come and the older ones are revised;
    then some are deleted; then the second batch is delivered once more.
    """
    old, late = F.pmod("doc_id", F.lit(11)) == 5, F.pmod("doc_id", F.lit(7)) == 3
    columns = ["op", "doc_id", "text", "source", "lang"]
    rows = docs.withColumn("op", F.lit("upsert"))
    half = F.substring(F.col("text"), F.lit(1), (F.char_length("text") / 2).cast("int"))
    first = rows.filter(~late).withColumns({"text": F.when(old, half).otherwise(F.col("text")), "source": F.when(old, F.lit("import")).otherwise(F.col("source"))})
    second = rows.filter(late | old)
    gone = docs.filter(F.pmod("doc_id", F.lit(13)) == 1).withColumn("op", F.lit("delete")).withColumn("text", F.lit(None).cast("string"))
    feed = [("load", first), ("revise", second), ("delete", gone), ("revise", second)]
    return [(name, df.select(*columns)) for name, df in feed]


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {v: F.regexp_count("text", F.lit(p)) for v, p in TOKENIZERS.items()}
    ledger = rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", counts)
    for name, changes in change_feed(table(spark, sf_dir, "documents")):
        ledger.apply(name, changes)
    return ledger.totals()


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    found = found.withColumn("items", items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("text", 256).alias("text_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html.extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return done.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_fingerprint, op2_ngram_lm, op3_quality_ranking, op4_vector_sharding, op5_minhash_dedup, op6_token_rollup, op7_byte_bpe, op8_decontamination, op9_line_dedup, op10_html_text, op11_vector_codes, op12_nearest_neighbours, op13_source_divergence, pipeline]
    return {f.__name__: f for f in named}


_OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
    ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS sh FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

_OP6_SQL = "\nUNION ALL\n".join(
    f"SELECT source, lang, '{v}' AS version, count(*) AS docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{p}'))) AS BIGINT) AS tokens FROM documents WHERE doc_id % 13 <> 1 GROUP BY source, lang" for v, p in TOKENIZERS.items()
)

_OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(l), 10) AS n, unnest(list_transform(range(1, greatest(2, len(l) - 8)), lambda k: array_to_string(l[k:k + 9], ' '))) AS t FROM i WHERE len(l) > 0),
sizes AS (SELECT DISTINCT n FROM win),
span AS (
  SELECT doc_id, n, unnest(range(1, len(l) - n + 2)) AS p, unnest(list_transform(range(1, len(l) - n + 2), lambda k: array_to_string(l[k:k + n - 1], ' '))) AS t FROM d, sizes WHERE len(l) >= n),
m AS (SELECT span.doc_id, span.p, span.n, win.item_id FROM span JOIN win ON span.t = win.t AND span.n = win.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN u USING (doc_id)
"""

_OP9_SQL = r"""
WITH l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l0),
l AS (SELECT doc_id, line, words, row_number() OVER o - 1 AS i, sum(words) OVER o - words AS before, sum(words) OVER (PARTITION BY doc_id) AS total FROM l1 WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT a.doc_id, a.i, count(*) AS n, string_agg(b.line, chr(10) ORDER BY b.i) AS t FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.before < a.before + 50 WHERE a.total - a.before >= 50 GROUP BY a.doc_id, a.i),
g AS (SELECT a.doc_id, min(b.i) AS i, count(*) AS n, string_agg(b.line, chr(10) ORDER BY b.i) AS t FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.before + b.words > a.before + a.words - 50 WHERE a.before + a.words >= 50 GROUP BY a.doc_id, a.i),
w AS (SELECT * FROM f UNION SELECT * FROM g),
first AS (SELECT t, min({'d': doc_id, 'i': i}) AS p FROM w GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM w JOIN first USING (t) WHERE {'d': doc_id, 'i': i} > p),
runs AS (SELECT doc_id, count(*) AS n_deleted, count(*) FILTER (WHERE prev IS NULL OR prev < i - 1) AS n_runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM gone) GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i WHERE gone.i IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs, sha256(CASE WHEN n_deleted IS NULL THEN d.text ELSE coalesce(kept.t, '') END) AS text_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11_sql(rounds: int = 4) -> str:
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE}),
part AS MATERIALIZED (
  SELECT r, p, x, list_inner_product(x, x) AS xx FROM (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) AS t(p))),
book0 AS MATERIALIZED (SELECT p, r - 1 AS j, x AS c FROM part WHERE r <= 256)"""]
    for n in range(rounds + 1):
        steps.append(f"""
near{n} AS MATERIALIZED (
  SELECT r, p, min({{'d': xx - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'j': j}}) AS m FROM part JOIN book{n} USING (p) GROUP BY r, p)""")
        if n < rounds:
            steps.append(f"""
mean{n} AS (
  SELECT p, j, list(y ORDER BY k) AS c FROM (
    SELECT p, m.j AS j, k, floor(sum(x[k]) / count(*)) AS y FROM near{n} JOIN part USING (r, p), unnest(range(1, len(x) + 1)) AS t(k) GROUP BY p, m.j, k) GROUP BY p, j),
book{n + 1} AS MATERIALIZED (SELECT p, j, coalesce(mean{n}.c, book{n}.c) AS c FROM book{n} LEFT JOIN mean{n} USING (p, j))""")
    return ",".join(steps) + f""",
sha AS (SELECT sha256(coalesce(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, j), '')) AS h FROM book{rounds}),
done AS (SELECT r, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN done USING (r), sha"""


_OP12_SQL = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER () AS r FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, a.r AS q, b.vec_id, b.r, list_inner_product(a.x, b.x) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.r <> b.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) <= 20
"""

_OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, k.n AS all_n, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang)
  LEFT JOIN (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM w GROUP BY lang, source, term) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER s + 5 * count(*) OVER s) AS p, 1 + 1000000000 * (all_n + 5) // (sum(all_n) OVER s + 5 * count(*) OVER s) AS q
  FROM c WINDOW s AS (PARTITION BY lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER o AS INTEGER) AS rank FROM parts
WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))
QUALIFY part = 'pair' OR row_number() OVER o <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_dedup": _OP5_SQL, "op6_token_rollup": _OP6_SQL, "op8_decontamination": _OP8_SQL, "op9_line_dedup": _OP9_SQL, "op11_vector_codes": _op11_sql(), "op12_nearest_neighbours": _OP12_SQL, "op13_source_divergence": _OP13_SQL}
