"""Quality by regularised quadratic discriminant analysis over document statistics.

One pass over the whole texts makes transformed statistics per document.  Class
means and covariances are sums over all learning rows, added up by Spark; each
covariance is shrunk towards the pooled one and towards its diagonal, and
factored once (Cholesky).  A score is the posterior of class 1 from the
difference of log densities, that is of Mahalanobis distances and determinants.

Edge cases: null and empty texts have the statistics of an empty text and a
score like any other; labels that are null do not count, several of one document
count by the greatest; with fewer than two classes the score is 1 for class 1 only, 0
for class 0 only and 0.5 without labels; repeated rows are scored each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

_CLASS = np.zeros(256, np.int64)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[ord(c) for c in "0123456789"]] = 2
_CLASS[[ord(c) for c in " \t\r\n\v\f"]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!"]] = 5
_CLASS[[ord(c) for c in "|<>{}[]\\/=_"]] = 6
_CLASS[[ord(c) for c in "#$%&*@+~^`"]] = 7
_CLASS[0x80:] = 8

STATS = 16


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    t = text or ""
    raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    share = np.bincount(_CLASS[raw], minlength=9) / n if len(raw) else np.zeros(9)
    words = t.split()
    w = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in t.split("\n") if x.strip()]
    k = max(len(lines), 1)
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    root = lambda x: np.sqrt(max(x, 0.0))
    return np.array([
        np.log1p(len(raw)), root(share[1]), root(share[2]), share[3], root(share[4]), root(share[5]), root(share[6]), root(share[7]), root(share[8]),
        size.mean(), np.log1p(size.std()), np.log(len(seen) / w) if words else 0.0, root(max(seen.values(), default=0) / w),
        root(1 - len(set(lines)) / k), np.log1p(w / k), root(sum(x == 1 for x in seen.values()) / w),
    ])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics, x."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, STATS)
            flat = pa.array(x.ravel())
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, flat)], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


class Discriminant:
    """Gaussian class densities with shrunk covariances and cached Cholesky factors."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = 0.1, diagonal: float = 0.1, floor: float = 1e-4):
        self.n = n
        self.prior = n / max(n.sum(), 1)
        self.ready = bool((n > 1).all())
        if not self.ready:
            return
        self.mean = sums / n[:, None]
        own = np.stack([squares[c] / n[c] - np.outer(self.mean[c], self.mean[c]) for c in range(2)])
        pooled = (own * n[:, None, None]).sum(0) / n.sum()
        self.factor, self.logdet = [], []
        for c in range(2):
            s = (1 - shrink) * own[c] + shrink * pooled
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s))
            f = np.linalg.cholesky(s + floor * np.eye(len(s)))
            self.factor.append(np.linalg.inv(f))  # lower triangular; kept so that a score is one product
            self.logdet.append(2 * np.log(np.diag(f)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if not self.ready:
            return np.full(len(x), 0.5 if self.n.sum() == 0 else float(self.prior[1] > 0.5))
        logs = []
        for c in range(2):
            z = (x - self.mean[c]) @ self.factor[c].T
            logs.append(np.log(self.prior[c]) - 0.5 * ((z * z).sum(1) + self.logdet[c]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, learn: Column, label_col: str, **how) -> Discriminant:
    """Sums over every learning row; ``learn`` is a condition on doc_id."""
    y = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    rows = stats.where(learn).join(y, F.col("doc_id") == F.col("id")).select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(STATS)])
    pairs = [(i, j) for i in range(STATS) for j in range(i + 1)]
    got = rows.groupBy("y").agg(
        F.count("*").alias("n"), F.array(*[F.sum(f"x{i}") for i in range(STATS)]).alias("s"),
        F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("q"),
    ).collect()
    n, sums, squares = np.zeros(2), np.zeros((2, STATS)), np.zeros((2, STATS, STATS))
    for r in got:
        n[r.y], sums[r.y] = r.n, r.s
        for (i, j), v in zip(pairs, r.q):
            squares[r.y, i, j] = squares[r.y, j, i] = v
    return Discriminant(n, sums, squares, **how)


def scored(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, score."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "quality")
    stats = tmp.write(measured(docs, id_col, text_col), "stats")
    model = fit(stats, labels, learn, label_col, **how)

    @F.pandas_udf("double")
    def posterior(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(model.score(np.array(x.to_list()).reshape(-1, STATS)))

    return stats.select("doc_id", posterior("x").alias("score"))
