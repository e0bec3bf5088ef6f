"""Quality scores by Bradley-Terry ranking: logistic loss on feature differences of preference pairs.

A document of label 1 is preferred to one of label 0. The fit takes a bounded sample of labelled rows
(``SAMPLE_ROWS``, the lowest hashes of doc_id) and ``RIVALS`` partners for each of its rows; everything else covers
all documents. The linear score is cut at the quantile of the sample's scores that separates its labels best, and
mapped to 0..1 so that the cut is at 0.5.

Defined cases: a null text counts as empty and is scored like any other; a doc_id with both labels is left out of
the fit, one with several texts is fitted by one of them, and each of its rows is scored; equal texts have equal
scores, and a score at the cut is 0.5, so it passes; a very long text is read whole in its row's task; a sample without
both labels gives every document 0.5, an empty table no rows; carried columns may have any name but the score's
(``fresh`` gives such); doc_id, labels, lang and source are never features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, text_or_empty, utf8_values

SAMPLE_ROWS, RIVALS, ROUNDS, RIDGE = 12_000, 12, 40, 1e-3
FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "space", "line", "stop", "comma", "shout", "ask", "bar", "mark", "other", "high",
    "mean_word", "distinct", "repeat", "unlettered", "line_words", "line_distinct", "has_mark", "has_bar", "has_upper", "has_shout", "has_repeat", "few_distinct", "low_lower", "short",
)
_MARKS = np.frombuffer(b"$&*%#@^~=+<>_/\\", np.uint8)
_OTHERS = np.frombuffer(b"\"'()[]{}:;-`", np.uint8)


def features(text: bytes) -> np.ndarray:
    n = max(1, len(text))
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    words, lines = text.split(), text.split(b"\n")
    n_words = max(1, len(words))
    upper, mark = histogram[65:91].sum(), histogram[_MARKS].sum()
    repeat = sum(map(bytes.__eq__, words, words[1:])) / n_words
    distinct = len(set(words)) / n_words
    letters = histogram[97:123].sum()
    clear = sum(map(bytes.isalpha, words)) / n_words
    shout, bar = histogram[33], histogram[124]
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), upper, histogram[48:58].sum(), histogram[32], histogram[10], histogram[46], histogram[44], shout, histogram[63], bar, mark, histogram[_OTHERS].sum(), histogram[128:].sum(),
        min(20.0, len(text) / n_words), distinct, repeat, 1 - clear, np.log1p(n_words / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        min(1.0, mark * 20), min(1.0, bar * 20), min(1.0, upper * 4), min(1.0, shout * 20), min(1.0, repeat * 5), max(0.0, 1 - distinct * 3), max(0.0, 0.5 - letters), max(0.0, 1 - len(words) / 10),
    ])


def _featured(batches):
    for batch in slices(batches, 500):
        rows = [features(t) for t in utf8_values(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, cut: float):
        self.mean, self.scale, self.weight, self.cut = mean, scale, weight, cut

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.margin(x) - self.cut).clip(-50, 50)))


def fit(x: np.ndarray, label: np.ndarray, rivals: int = RIVALS, rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """Newton steps on the mean logistic loss of differences between preferred and other rows."""
    width = x.shape[1] if x.size else len(FEATURES)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = ((x - mean) / scale).clip(-8, 8)
    draw = np.random.default_rng(0)
    n = max(len(good), len(bad)) * rivals
    difference = z[good[draw.permutation(n) % len(good)]] - z[bad[draw.permutation(n) % len(bad)]]
    weight = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(difference @ weight).clip(-50, 50)))
        gradient = difference.T @ (p - 1) / n + ridge * weight
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / n + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        weight -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, weight, quantile_cut(z @ weight, label))


def quantile_cut(margins: np.ndarray, label: np.ndarray) -> float:
    """Midway between the two neighbouring scores whose quantile makes the fewest errors, each label weighted alike."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], label[order] == 1
    lost = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())  # good rows below the cut
    kept = 1 - np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum())  # bad rows above it
    least = lost + kept
    ties = np.flatnonzero(least <= least.min() + 1e-12)
    at = int(ties[len(ties) // 2])
    if at == 0:
        return float(m[0]) - 1e-9
    return float(m[-1]) + 1e-9 if at == len(m) else float(m[at - 1] + m[at]) / 2


def remainder(mod: int = 3):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 1, mod: int = 3, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of labelled documents; those whose crc32(doc_id) mod ``mod`` is ``held_out`` are never looked at."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    if held_out is not None:
        known = known.filter(remainder(mod) != held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    half = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2) for q in (0, 1)]
    sample = F.broadcast(half[0].unionByName(half[1]))  # at most sample_rows pairs of numbers
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).join(sample, "doc_id")
    # A copied doc_id would bring back more rows than the sample has: the least of its rows' features stands for it.
    featured = texts.select("doc_id", "quality", "text").mapInArrow(_featured, "doc_id long, quality int, x array<double>")
    rows = featured.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()  # at most sample_rows rows
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["quality"].to_numpy())


def score_documents(docs: DataFrame, model: Model, carry: list[str], name: str = "score") -> DataFrame:
    """The columns ``carry`` of every document, and its score under ``name``."""
    body = fresh(docs, "body")
    source = docs.select(*[F.col(f"`{c}`") for c in carry], text_or_empty().alias(body))

    def scored(batches):
        for batch in slices(batches, 500):
            x = np.stack([features(t) for t in utf8_values(batch.column(batch.num_columns - 1))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x), pa.float64())], [*carry, name])

    return source.mapInArrow(scored, T.StructType([*source.schema.fields[:-1], T.StructField(name, T.DoubleType())]))
