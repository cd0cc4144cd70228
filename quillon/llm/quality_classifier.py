"""Quality classifier: regularised quadratic discriminant over document statistics.

Features are transformed statistics of the whole text.  Each class has its mean and a
covariance shrunk towards the pooled one and towards the pooled diagonal; the score is
the logistic of the difference of the two log densities, each a Mahalanobis distance
through a Cholesky factor that is computed once and kept with the model, plus the log
prior ratio.  The fit needs only counts, sums and sums of products, which are summed on
the executors over all training rows.

Edge cases: null or empty text has all statistics 0 and a score like any other; with no
training rows, or of one class only, every score is 0.5; null labels are no labels; null
doc_id is scored and never trained on; repeated rows are each scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, materialize
from quillon.llm.docstats import COUNTS, document_statistics

N_FEATURES = 13


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of transformed statistics: log counts and log ratios with a floor."""
    s = {k: np.asarray(v, np.float64) for k, v in s.items()}
    words, chars, lines = (np.maximum(s[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    part = lambda a, b, eps: np.log(a / b + eps)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words / 10, np.log(lines) - np.log1p(s["n_words"]) / 2,
        part(s["n_upper"], chars, 0.02), part(s["n_symbols"], chars, 0.005), part(s["n_punct"], chars, 0.01),
        part(s["n_bang"], words, 0.02), part(s["n_pipe"], words, 0.02), part(s["n_dup_lines"], lines, 0.1),
        part(s["n_repeat_words"], words, 0.05), part(s["n_same_next"], words, 0.02), part(s["n_digits"], chars, 0.01),
        s["n_distinct_words"] / words + 0.08 * np.log1p(s["n_words"]),
    ])


class Model:
    """Means, cached Cholesky factors and log determinants of two shrunk Gaussians."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, ridge: float = 0.05):
        self.fitted = all(moments.get(c, (0,))[0] >= 2 for c in (0, 1))
        if not self.fitted:
            return
        d = N_FEATURES
        n = {c: moments[c][0] for c in (0, 1)}
        mean = {c: moments[c][1] / n[c] for c in (0, 1)}
        scatter = {c: moments[c][2] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        diagonal = np.diag(np.maximum(np.diag(pooled), 1e-4))
        self.mean, self.factor, self.logdet = mean, {}, {}
        for c in (0, 1):
            few = d / (d + n[c])  # more shrinkage where rows are few
            a = min(1.0, shrink + few)
            cov = (1 - a) * scatter[c] / n[c] + a * ((1 - ridge) * pooled + ridge * diagonal) + 1e-3 * diagonal
            low = np.linalg.cholesky(cov)
            self.factor[c] = np.linalg.inv(low)  # applied to each batch
            self.logdet[c] = 2 * np.log(np.diag(low)).sum()
        self.prior = np.log(n[1] / n[0])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        z = {}
        for c in (0, 1):
            y = (x - self.mean[c]) @ self.factor[c].T
            z[c] = -0.5 * ((y * y).sum(1) + self.logdet[c])
        return 1 / (1 + np.exp(-np.clip(z[1] - z[0] + self.prior, -40, 40)))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return features({k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in COUNTS})


def fit(training: DataFrame) -> Model:
    """training: COUNTS and label (0 or 1).  Partial moments of each task are summed by Spark."""
    size = 1 + N_FEATURES + N_FEATURES * N_FEATURES

    def moments(batches):
        total = np.zeros((2, size))
        for b in batches:
            x, y = _matrix(b), b.column(b.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                v = x[y == c]
                total[c, 0] += len(v)
                total[c, 1 : 1 + N_FEATURES] += v.sum(0)
                total[c, 1 + N_FEATURES :] += (v.T @ v).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size)), pa.array(np.tile(np.arange(size), 2)), pa.array(total.ravel())], ["label", "at", "value"])

    sums = training.select(*COUNTS, "label").mapInArrow(lean(moments), "label long, at long, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()  # 2 * size rows
    total = np.zeros((2, size))
    for label, at, value in sums:
        total[label, at] = value
    return Model({c: (t[0], t[1 : 1 + N_FEATURES], t[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES)) for c, t in enumerate(total)})


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the decimal doc_id leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text)."""
    stats = materialize(document_statistics(docs))
    known = labels.where("quality in (0, 1)").where(~held_out(modulus, remainder)).select("doc_id", F.col("quality").cast("long").alias("label"))
    model = fit(stats.join(known, "doc_id"))

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_matrix(b)))], ["doc_id", "score"])

    out = stats.select("doc_id", *COUNTS).mapInArrow(lean(score), "doc_id long, score double")
    return out.withColumn("held_out", held_out(modulus, remainder)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
