"""Language identification by error-correcting output codes.

Every language has a codeword.  One binary character n-gram classifier per bit
(log-odds of hashed 1- to 3-grams between the languages with and without the
bit) gives a margin; decoding takes the codeword with the least logistic loss
over bits, each bit weighted by its reliability on the training rows.  A small
gap between the two nearest codewords flags the text as ambiguous.

The classifiers learn n-gram counts from a bounded sample, ``train_rows``
labelled rows by hash order; every text is then predicted whole.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
without any training row every text is ``und``; with one language every text
with letters has that language and score 1; repeated rows are predicted each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches

BUCKETS = 8192
UND = "und"
_TABLE = 0x3000  # code points below are classed by table


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_TABLE)])


_IS_LETTER = _letters()


def profile(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the lower-cased text, runs of non-letters as one blank; None without letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if c.max() < _TABLE:
        letter = _IS_LETTER[c]
    else:
        far = c >= _TABLE
        letter = _IS_LETTER[np.where(far, 0, c)]
        u, back = np.unique(c[far], return_inverse=True)
        letter[far] = np.array([chr(x).isalpha() for x in u.tolist()])[back]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = c[keep]
    out = np.bincount((c * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=BUCKETS)
    if len(c) > 1:
        two = c[:-1] * np.uint32(0x85EBCA6B) ^ c[1:] * np.uint32(0xC2B2AE35)
        out += np.bincount((two * np.uint32(0x27D4EB2F)) >> np.uint32(19), minlength=BUCKETS)
    if len(c) > 2:
        three = two[:-1] * np.uint32(0x165667B1) ^ c[2:] * np.uint32(0x9E3779B1)
        out += np.bincount((three * np.uint32(0x85EBCA6B)) >> np.uint32(19), minlength=BUCKETS)
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1: every split of up to six languages, else the best spread of some random codes."""
    if n <= 6:
        cols = [(1, *c) for c in product((1, -1), repeat=n - 1)][1:]
        return np.array(cols, np.int8).T.reshape(n, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        d = (bits - code.astype(int) @ code.T) // 2
        np.fill_diagonal(d, bits)
        if d.min() > far:
            best, far = code, d.min()
    return best[:, np.abs(best.sum(0)) < n]


class Model:
    """Languages, their codewords, the bits' n-gram weights and reliabilities."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        n = len(langs)
        self.code = codewords(n) if n > 1 else np.zeros((n, 0), np.int8)
        rate = (counts + smooth) / (counts + smooth).sum(1, keepdims=True)
        plus, minus = self.code > 0, self.code < 0
        weight = [np.log(rate[plus[:, b]].mean(0)) - np.log(rate[minus[:, b]].mean(0)) for b in range(self.code.shape[1])]
        self.weight = np.array(weight, np.float32).reshape(-1, BUCKETS).T
        self.trust = np.ones(self.code.shape[1])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margin of each bit: mean log-odds of an n-gram, times the evidence that the text's length gives."""
        n = x.sum(1, keepdims=True).astype(np.float32)
        return (x.astype(np.float32) @ self.weight) / np.maximum(n, 1) * (12 * n / (n + 60))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and the gap to the next one."""
        n = len(self.langs)
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        m = self.margins(x)
        loss = (self.trust * np.logaddexp(0, -m[:, None, :] * self.code[None])).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return loss.argmin(1), order[:, -1], order[:, -1] - order[:, -2]


def train(docs: DataFrame, learn: Column, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on at most ``train_rows`` rows for which ``learn`` holds, chosen by hash of the id; profiles are summed on the executors."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = bounded_sample(rows.select(F.col(id_col).alias("id")), train_rows, "id").distinct()
    few = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), "id", "left_semi")
    few = few.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r")).select("id", "r.*")  # one text for each id, however often it repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1)):
                x = profile(t.as_py())
                if x is not None:
                    name = lang.as_py()
                    sums[name] = sums[name] + x if name in sums else x.astype(np.int64)
        names = sorted(sums)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([sums[k].astype("<i8").tobytes() for k in names], pa.binary())], ["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    # Few tasks, so that few sums come back.
    for r in few.select("text", "lang").coalesce(16).mapInArrow(run, "lang string, counts binary").collect():
        x = np.frombuffer(r.counts, "<i8")
        total[r.lang] = total[r.lang] + x if r.lang in total else x
    if not total:
        return None
    langs = sorted(total)
    model = Model(langs, np.stack([total[k] for k in langs]))
    # Reliability of the bits, from a smaller bounded part of the same rows.
    few_ids = bounded_sample(ids, 1000, "id")
    part = few.join(F.broadcast(few_ids), "id", "left_semi").select("text", "lang")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(x, lang.as_py()) for t, lang in zip(b.column(0), b.column(1)) if (x := profile(t.as_py())) is not None]
            if got:
                x = np.stack([g[0] for g in got])
                right = np.sign(model.margins(x)) == model.code[[langs.index(g[1]) for g in got]]
                yield pa.RecordBatch.from_arrays([pa.array([len(got)]), pa.array([right.sum(0).tolist()], pa.list_(pa.int64()))], ["n", "right"])

    got = part.mapInArrow(sketch, "n long, right array<long>").collect()
    n = sum(r.n for r in got)
    if n and model.code.shape[1]:
        wrong = np.clip(1 - np.sum([r.right for r in got], axis=0) / n, 1e-3, 0.49)
        w = np.log((1 - wrong) / wrong)
        model.trust = w / w.mean()
    return model


def _judged(model: Model | None, texts: pa.Array, ambiguous: float) -> list[pa.Array]:
    """lang_pred, score, ambiguous of a batch of texts."""
    n = len(texts)
    lang, score, unsure = [UND] * n, np.zeros(n), np.ones(n, bool)
    for at in range(0, n, 256):
        got = [(k, x) for k, t in enumerate(texts[at : at + 256], at) if model is not None and (x := profile(t.as_py())) is not None]
        if got:
            rows = np.array([g[0] for g in got])
            best, p, gap = model.decode(np.stack([g[1] for g in got]))
            score[rows], unsure[rows] = p, gap < ambiguous
            for r, k in zip(rows.tolist(), best.tolist()):
                lang[r] = model.langs[k]
    return [pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(unsure)]


def identify(docs: DataFrame, model: Model | None, ambiguous: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_judged(model, b.column(1), ambiguous)], ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame, model: Model | None, ambiguous: float = 0.2, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found and not ambiguous; rows are judged where they are, without a join."""
    small_batches(docs.sparkSession)
    at = docs.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, _, unsure = _judged(model, b.column(at), ambiguous)
            keep = [x != UND and not u for x, u in zip(lang.to_pylist(), unsure.to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
