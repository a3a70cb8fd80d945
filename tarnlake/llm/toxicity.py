"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their long prefixes, hashed to 2**20 places.
A bounded sample of labelled rows, ``train_rows`` by hash order, selects the
terms that carry evidence and fits the machine: a weight for every term and a
short vector for every term, whose inner products are the weights of pairs, so
that an insult with a group mention can weigh more than the two alone.  Every
text is then scored whole.

Edge cases: null and empty texts have no term and the score of the bias; labels
that are null do not count, several of one document count by the greatest;
without two classes of labels every score is the smoothed rate of class 1;
repeated rows are scored each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches

PLACES = 1 << 20
_WORD = re.compile(r"\w+")


def places_of(word: str) -> tuple[int, ...]:
    """Hashed places of a word's terms: itself and its prefixes of four to seven letters."""
    own = [word, *(f"{word[:k]}*" for k in range(4, min(8, len(word) + 1)))]
    return tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % PLACES for t in own)


class Terms:
    """Distinct places of a text; the memory of words is bounded and starts anew when full."""

    def __init__(self, keep: np.ndarray | None = None, most: int = 500_000):
        self.keep = None if keep is None else {int(p): k for k, p in enumerate(keep)}
        self.most, self.known = most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted places, or positions among the kept ones."""
        known, out = self.known, set()
        for w in set(_WORD.findall((text or "").lower())):
            got = known.get(w)
            if got is None:
                got = places_of(w)
                if self.keep is not None:
                    got = tuple(self.keep[p] for p in got if p in self.keep)
                if len(known) >= self.most:
                    known.clear()
                known[w] = got
            out.update(got)
        return np.array(sorted(out), np.int32)


def select(rows: list[np.ndarray], y: np.ndarray, least: int, most: int) -> np.ndarray:
    """Places in at least ``least`` rows with the greatest z-scores of their class rates."""
    every = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    n = np.bincount(every, minlength=PLACES)
    hit = np.bincount(every, np.repeat(y, [len(r) for r in rows]), PLACES)
    rate = y.mean()
    z = np.abs(hit - n * rate) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate))
    z[n < least] = 0
    order = np.argsort(-z, kind="stable")[:most]
    return np.sort(order[z[order] > 3])


class Machine:
    """bias + w.x + sum of <v_i, v_j> x_i x_j over pairs of present terms."""

    def __init__(self, keep: np.ndarray, rank: int = 6, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.keep, self.b = keep, 0.0
        self.w = np.zeros(len(keep))
        self.v = 0.01 * rng.normal(size=(len(keep), rank))

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.b + x @ self.w + 0.5 * ((s * s).sum(1) - (x @ (self.v * self.v)).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.15, l2: float = 5e-4, positive: float = 2.0, seed: int = 5) -> Machine:
        """AdaGrad on the logistic loss; a row of class 1 counts ``positive`` times."""
        rng = np.random.default_rng(seed)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.b = float(np.log(p / (1 - p)))
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                own = order[at : at + batch]
                x = dense([rows[i] for i in own], len(self.keep))
                e = (self.score(x) - y[own]) * np.where(y[own] > 0, positive, 1.0) / len(own)
                s = x @ self.v
                dw = x.T @ e + l2 * self.w / len(own)
                dv = x.T @ (e[:, None] * s) - (x.T @ e)[:, None] * self.v + l2 * self.v / len(own)
                gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + e.sum() ** 2
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= 0.3 * rate * dv / np.sqrt(gv)
                self.b -= rate * e.sum() / np.sqrt(gb)
        return self


def dense(rows: list[np.ndarray], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        x[k, r] = 1
    return x


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", train_rows: int = 12_000, least: int = 8, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on at most ``train_rows`` labelled rows for which ``learn`` (a condition on doc_id) holds, by hash of the id."""
    small_batches(docs.sparkSession)
    y = labels.select(F.col("doc_id").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(learn & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    y = bounded_sample(y.groupBy("doc_id").agg(F.max("y").alias("y")), train_rows, "doc_id")
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(y), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            found = [terms(t.as_py()).astype("<i4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = few.mapInArrow(run, f"doc_id {kind}, y int, terms binary").groupBy("doc_id").agg(F.min(F.struct("y", "terms")).alias("r"))
    got = made.select("doc_id", "r.*").collect()  # places only, of a bounded sample: one text for each id
    got.sort(key=lambda r: (r.doc_id, r.terms))
    rows, y = [np.frombuffer(r.terms, "<i4") for r in got], np.array([r.y for r in got], float)
    if len(set(y)) < 2:
        m = Machine(np.zeros(0, np.int64))
        p = (y.sum() + 0.5) / (len(y) + 1)
        m.b = float(np.log(p / (1 - p)))
        return m
    keep = select(rows, y, least, most)
    place = np.full(PLACES, -1)
    place[keep] = np.arange(len(keep))
    rows = [p[p >= 0] for r in rows for p in [place[r]]]
    return Machine(keep).fit(rows, y)


def scored(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.keep)
        for b in batches:
            rows = [terms(t.as_py()) for t in b.column(1)]
            score = np.concatenate([model.score(dense(rows[at : at + 128], len(model.keep))) for at in range(0, len(rows), 128)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
