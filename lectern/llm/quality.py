"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of each text are transformed (logarithms and logits), so that a Gaussian per class fits them. Counts, sums and
sums of products per class come from all labelled rows outside the held-out fold, by aggregation. A class's covariance is
shrunk towards the pooled one and that towards its diagonal; Cholesky factors are made once and sent to the tasks. A
score is the logistic function of the difference of the log densities and the log ratio of the class sizes.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize

NAMES = ["words", "word_length", "spread", "capitals", "signs", "marks", "digits", "bars", "variety", "top_word", "repeats", "short_ends", "line_copies", "commas"]
FOLDS = 5


def _logit(k: float, n: float) -> float:
    """Log odds of a share of ``k`` in ``n``, smoothed by half a case on either side."""
    return math.log((k + 0.5) / (n - k + 0.5)) if n else 0.0


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES; an empty text has zeros."""
    units = text.split()
    if not units:
        return [0.0] * len(NAMES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, total = len(units), max(1, int(raw.sum()))
    sizes = np.fromiter(map(len, units), np.int32, n)
    count = Counter(units)
    lines = [x for x in text.split("\n") if x]
    letters = int(raw[65:91].sum() + raw[97:123].sum())
    same = sum(a == b for a, b in zip(units, units[1:], strict=False))
    return [
        math.log1p(n),
        math.log(sizes.mean()),
        math.log1p(sizes.std()),
        _logit(int(raw[65:91].sum()), letters),
        _logit(int(sum(raw[ord(c)] for c in "#$%&*@^~<>{}[]\\_")), total),
        _logit(int(raw[33] + raw[63]), total),
        _logit(int(raw[48:58].sum()), total),
        _logit(int(raw[124]), total),
        _logit(len(count), n),
        _logit(max(count.values()), n),
        _logit(same, n - 1),
        _logit(int((sizes <= 2).sum()), n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(int(raw[44] + raw[46]), total),
    ]


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of both classes, and the log ratio of their sizes."""

    means: tuple
    factors: tuple
    log_dets: tuple
    log_ratio: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.log_ratio, -500, 500)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = 0.1, ridge: float = 0.05) -> Model | None:
    """The model of class counts, sums and sums of products; None unless both classes have rows."""
    if min(n) < 1:
        return None
    means = sums / n[:, None]
    scatter = [products[c] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / max(1.0, n.sum() - 2)
    pooled = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
    factors, dets = [], []
    for c in (0, 1):
        own = (1 - shrink) * scatter[c] / max(1.0, n[c] - 1) + shrink * pooled
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Model(tuple(means), tuple(factors), tuple(dets), math.log(n[1] / n[0]))


def with_statistics(df: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """Append ``out_col`` (array of double). Null and empty texts have zeros; a column of that name is replaced."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([statistics(t.as_py() or "") for t in texts], pa.list_(pa.float64()))]

    return append_columns(df, [T.StructField(out_col, T.ArrayType(T.DoubleType()))], compute, [text_col])


def held_out(key: str) -> F.Column:
    """Whether a row is in the fold that is never learnt from; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS == 0


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", shrink: float = 0.1) -> Model | None:
    """Fit on all rows of ``stats`` with a label outside the held-out fold.

    Several labels of one key are averaged and halves round up; null labels and null keys are not used. Only sums of
    one number, a vector and a matrix per class reach the driver. None if a class has no rows.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_mark"))
    rows = stats.select(key, "stats").where(~held_out(key)).join(marks, key).select("_mark", "stats")
    size = len(NAMES)

    def add(batches):
        n, sums, products = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
        for b in batches:
            if b.num_rows:
                mark = b.column(0).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                for c in (0, 1):
                    own = x[mark == c]
                    n[c] += len(own)
                    sums[c] += own.sum(0)
                    products[c] += own.T @ own
        flat = np.concatenate([n, sums.ravel(), products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    total = np.zeros(2 + 2 * size + 2 * size * size)
    for i, v in rows.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        total[i] = v
    return fit(total[:2], total[2 : 2 + 2 * size].reshape(2, size), total[2 + 2 * size :].reshape(2, size, size), shrink)


def _scores(x: np.ndarray, model: Model | None) -> pa.Array:
    return pa.array(model.scores(x) if model else np.full(len(x), 0.5), pa.float64())


def score(stats: DataFrame, model: Model | None, out_col: str = "score", stats_col: str = "stats") -> DataFrame:
    """Append ``out_col`` (double, 0 to 1); without a model every score is 0.5. Null statistics are scored as those of an empty text."""

    def compute(stats: pa.Array) -> list[pa.Array]:
        x = np.zeros((len(stats), len(NAMES)))
        x[stats.is_valid().to_numpy(zero_copy_only=False)] = stats.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
        return [_scores(x, model)]

    return append_columns(stats, [T.StructField(out_col, T.DoubleType())], compute, [stats_col], rows=4096)


def score_texts(df: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The same from the texts, in one pass through a Python worker."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [_scores(np.array([statistics(t.as_py() or "") for t in texts]), model)]

    return append_columns(df, [T.StructField(out_col, T.DoubleType())], compute, [text_col])


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows (key, held_out, score, predicted) for each row of ``df``; texts are read once, their statistics kept as a table.

    Repeated rows are scored each; other columns are not read. Sums over an empty table give no model, see ``score``.
    """
    stats = materialize(with_statistics(df.select(key, text_col), text_col).drop(text_col), "stats")
    scored = score(stats, train(stats, labels, key))
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
