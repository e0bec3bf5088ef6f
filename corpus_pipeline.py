"""The corpus pipeline: five stages, each over all that the one before kept, each written and read again.

Defined cases of every stage: a null text counts as empty (line dedup leaves it null) and stays where nothing is found
in it; repeated rows are documents of their own until near-dedup keeps one; a null doc_id is an id that no label has; a
very long text is one row of one task; other columns pass through whatever their names; an empty table gives no rows.
Ties: a score at the cut stays; of equal lines and of near copies those of the smallest doc_id (then text) stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm import bpe, decontam, linedup, minhash, ranking
from speechmill.llm.common import fresh, materialize, table

#: A byte-BPE stage ends the pipeline; no stage before it can be said in SQL (a trained classifier is the first).
ORACLE_SQL: str | None = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score is under the quantile cut go. All labels may teach it here."""
    model = ranking.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=None)
    score = fresh(docs, "score")
    return ranking.score_documents(docs, model, docs.columns, score).filter(F.col(score) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words or more go from the texts."""
    return linedup.without_repeats(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8) the row with the smallest doc_id stays."""
    return minhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids of the text, and whether they decode to its bytes."""
    import public_tokenizers

    return bpe.tokenized(docs, ["doc_id", "lang", "source"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
