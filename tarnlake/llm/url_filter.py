"""URL filter: explicit rules first, then gradient-boosted trees on lexical features.

Host, path and rules are SQL expressions.  The trees see the URL's text alone:
lengths, depth, digit and letter ratios, entropy, parameters, dashes, and two
suffix statistics, the smoothed block rates of the host's last label and of the
path's extension among labelled URLs.  They learn from URLs that no rule decides:
block or allow where the host holds a word of the seed lists, else allow as
background (as in learning from positive and unlabelled rows), or from a column of
labels.  No feature sees a word, so hosts with words of no list are judged by their
shape.  Features are made on the executors; those of a bounded sample,
``train_rows`` by hash order, fit the trees on the driver.

Edge cases: null URLs and URLs without ``://`` have empty host and path, match no
rule and get the trees' verdict on an empty text; without two classes of labels
every undecided URL is allowed; repeated rows are judged each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: Words whose presence in a host labels a training URL.
BLOCK_WORDS = ("casino", "bets", "betting", "pills", "pharma", "porn", "xxx", "viagra", "payday", "replica", "torrent", "warez")
ALLOW_WORDS = ("wiki", "docs", "library", "museum", "university", "archive", "gov", "edu")

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tried first, being outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def seed_of(host: Column, block: tuple[str, ...], allow: tuple[str, ...]) -> Column:
    has = lambda ws: F.exists(F.split(host, "[.-]"), lambda w: w.isin(*ws))
    return F.when(has(block), "block").when(has(allow), "allow")


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.bincount(np.frombuffer(s.encode("utf-8", "replace"), np.uint8))
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def _suffixes(host: str, path: str) -> tuple[str, str]:
    last = path.rpartition("/")[2]
    return host.rpartition(".")[2], last.rpartition(".")[2].lower() if "." in last else ""


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The numeric features of one URL."""
    u = url or ""
    rest = u.partition("?")[2].partition("#")[0]
    n = max(len(u), 1)
    labels = host.split(".") if host else []
    return [
        len(u), len(host), len(path), path.count("/"), len(labels), max(map(len, labels), default=0),
        host.count("-"), path.count("-") + path.count("_"), sum(c.isdigit() for c in u) / n, sum(c.isdigit() for c in host),
        max(map(len, re.findall(r"\d+", path)), default=0), _entropy(u), _entropy(host), len(rest.split("&")) if rest else 0,
        float("#" in u), float(u.startswith("https")), sum(not c.isalnum() for c in u) / n, float(labels[:1] in (["www"], ["m"])),
    ]


@dataclass
class Trees:
    """Histogram gradient boosting with logistic loss."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.25
    bins: int = 32
    l2: float = 1.0
    cuts: list = field(default_factory=list)
    base: float = 0.0
    trees: list = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self._binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, value = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += value
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """One tree as arrays (feature, bin, leaf value) in heap order, and its values on the rows."""
        size = 2 ** (self.depth + 1)
        feature, cut, leaf = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.ones(len(g), np.int64)
        for at in range(1, size):
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            leaf[at] = self.rate * gs / (hs + self.l2)
            if at >= size // 2:
                continue
            best, parent = 1e-6, gs * gs / (hs + self.l2)
            for k in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[own, k], g[own], self.bins + 1))[:-1]
                hl = np.cumsum(np.bincount(b[own, k], h[own], self.bins + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - parent
                gain[(hl < 1e-3) | (hs - hl < 1e-3)] = 0
                j = int(gain.argmax())
                if gain[j] > best:
                    best, feature[at], cut[at] = gain[j], k, j
            if feature[at] >= 0:
                node[own] = 2 * at + (b[own, feature[at]] > cut[at])
        return (feature, cut, leaf), leaf[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._binned(x)
        f = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                k = feature[node]
                go = k >= 0
                node = np.where(go, 2 * node + (b[np.arange(len(x)), np.maximum(k, 0)] > cut[node]), node)
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


def _place(suffix: str) -> int:
    """A suffix of any length as 63 bits."""
    return xxhash.xxh64_intdigest(suffix.encode("utf-8", "surrogatepass")) >> 1


@dataclass
class Model:
    trees: Trees | None
    rates: tuple[dict[int, float], dict[int, float]]
    rate: float

    def score(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probability of block."""
        return np.zeros(len(x)) if self.trees is None else self.trees.score(self._all(x, ends))

    def _all(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        known = [[r.get(e, self.rate) for e in ends[:, k].tolist()] for k, r in enumerate(self.rates)]
        return np.column_stack([x, *known])


def features(urls, hosts, paths) -> tuple[np.ndarray, np.ndarray]:
    """Lexical features and places of the two suffixes of each URL."""
    x = np.array([lexical(u, h, p) for u, h, p in zip(urls, hosts, paths)], np.float64).reshape(len(urls), -1)
    return x, np.array([list(map(_place, _suffixes(h, p))) for h, p in zip(hosts, paths)], np.int64).reshape(len(urls), 2)


def train(x: np.ndarray, ends: np.ndarray, y: np.ndarray, smooth: float = 20.0) -> Model:
    """Fit on features, suffix places and labels (1 is block)."""
    if len(set(y.tolist())) < 2:
        return Model(None, ({}, {}), 0.0)
    rate, rates = float(y.mean()), []
    for k in range(2):
        own, at = np.unique(ends[:, k], return_inverse=True)
        n, a = np.bincount(at), np.bincount(at, y)
        rates.append(dict(zip(own.tolist(), ((a + smooth * rate) / (n + smooth)).tolist())))
    model = Model(Trees(), tuple(rates), rate)
    model.trees.fit(model._all(x, ends), y)
    return model


def judge(
    pages: DataFrame, rules: list[Rule], train_rows: int = 20_000, threshold: float = 0.5, block_words: tuple[str, ...] = BLOCK_WORDS,
    allow_words: tuple[str, ...] = ALLOW_WORDS, label_col: str | None = None, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block); with ``label_col`` (block, allow or null) the trees learn from it alone."""
    spark = pages.sparkSession
    small_batches(spark)
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), label.alias("label"))
    rows = rows.select("page_id", "url", "label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    label = F.col("label")
    if label_col is None:
        label = F.coalesce(seed_of(F.col("host"), block_words, allow_words), F.lit("allow"))
    known = rows.where("url is not null and ruled is null").select("page_id", "url", "host", "path", (label == "block").cast("double").alias("y")).where("y is not null")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, ends = features(b["url"].to_list(), b["host"].to_list(), b["path"].to_list())
            yield pd.DataFrame({"x": [r.tobytes() for r in x], "ends": [r.tobytes() for r in ends], "y": b["y"]})

    few = bounded_sample(known, train_rows, "url", "page_id", "y")
    got = few.mapInPandas(made, "x binary, ends binary, y double").collect()  # numbers only, of a bounded sample
    model = train(np.array([np.frombuffer(r.x) for r in got]), np.array([np.frombuffer(r.ends, np.int64) for r in got]), np.array([r.y for r in got]))

    @F.pandas_udf("double")
    def block(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for u, h, p in parts:
            yield pd.Series(model.score(*features(u.to_list(), h.to_list(), p.to_list())))

    scored = rows.withColumn("score", block("url", "host", "path"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
