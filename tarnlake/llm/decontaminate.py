"""Benchmark decontamination by latent semantic retrieval.

The whole texts become hashed words once, kept in a table; three passes over it:

1. document frequencies of hashed terms over all passages of 32 words;
2. one pass sketch of the TF-IDF passage matrix A: every task adds up
   A^T (A Omega) for a fixed random Omega, the sums are added in a tree, and the
   driver takes the leading right singular vectors from that sketch (randomised
   SVD in its single pass, Nystrom form);
3. sliding windows of several lengths, projected on those vectors with each
   divided by its singular value (the first few, which tell languages apart, are
   left out), against the items of about that length: windows over a cosine
   threshold are candidates, and each candidate is decided by the longest common
   subsequence of words, or by a shorter one together with the item's answer, its
   last words.

Words are of letters and digits, lower-cased where ASCII or Latin-1, hashed to 16
bits; terms are 14 of these.  Two different words of an item and a window of some
eighty agree by chance 0.05 times, far below the thresholds.

The benchmark is a stated query set, collected in parts of about ``most_items`` items
and ``most_bytes`` bytes at most; the words are searched once for each part, with one set of vectors.

Edge cases: null and empty texts have no words and no match; items that are null
or have no word are not searched, those of fewer than ``least_words`` words match
where all their words (64-bit hashes) follow each other, with no cosine; repeated documents are
matched each, repeated items too; without documents or items the result is empty;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

TERMS = 1 << 14
PASSAGE = 32
#: Lengths of the sliding windows in words; each moves by a quarter of itself.
WINDOWS = (8, 12, 16, 24, 32, 40, 48, 56, 64, 80, 96, 128, 192, 256)
STEP = 4  # words in a block of summed vectors; every window is made of whole blocks
SKIP = 4  # leading singular vectors that are left out

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MIX = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[:1] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts laid end to end (bytes, end of each text), and the number of words up to each text's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    b = _FOLD[data]
    latin = np.flatnonzero(b[:-1] == 0xC3) + 1
    latin = latin[(b[latin] >= 0x80) & (b[latin] <= 0x9E) & (b[latin] != 0x97)]
    b[latin] += 0x20
    word = _WORD[b]
    marks = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x80)) if n > 2 else np.zeros(0, int)  # dashes, quotes and blanks beyond ASCII
    for k in range(3):
        word[marks + k] = False
    nbsp = np.flatnonzero((b[:-1] == 0xC2) & (b[1:] < 0xC0))
    word[nbsp] = word[nbsp + 1] = False
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < n)]
    cuts = cuts[word[cuts] & word[cuts - 1]] if len(cuts) else cuts  # texts may meet within letters
    at = np.flatnonzero(edge)
    starts, stops = at[0::2], at[1::2]
    if len(cuts):
        cuts = np.unique(cuts)
        starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
    up, down = _powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_MIX[b] * up[:n], out=s[1:])
    h = (s[stops] - s[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, np.searchsorted(starts, ends)


def _id(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.uint16)


def _term(ids: np.ndarray) -> np.ndarray:
    return ids >> np.uint16(2)


def word_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and words, the 16-bit hashes of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, h, upto in _slices(b.column(1)):
                ids = _id(h)
                out += [w.tobytes() for w in np.split(ids, upto[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, words binary")


def _slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: first row, last row + 1, word hashes, words up to each text's end."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in column], np.int64)
    for lo, hi in _runs(sizes, most):
        raw = b"".join(column[k].as_buffer().to_pybytes() for k in range(lo, hi) if sizes[k])
        h, upto = words_of(np.frombuffer(raw, np.uint8), np.cumsum(sizes[lo:hi]))
        yield lo, hi, h, upto


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo, total = 0, np.cumsum(sizes)
    while lo < len(sizes):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
        yield lo, hi
        lo = hi


def _kept(column: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of kept word ids, about ``most`` bytes each: first row, ids, words up to each text's end."""
    raw = [w.as_buffer() for w in column]
    sizes = np.array([len(r) for r in raw], np.int64)
    for lo, hi in _runs(sizes, most):
        yield lo, np.frombuffer(b"".join(raw[lo:hi]), np.uint16), np.cumsum(sizes[lo:hi]) // 2


def _passages(terms: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Passages of 32 words, never across texts, as sorted rows; TERMS stands for none."""
    starts = np.concatenate(([0], upto[:-1]))
    size = upto - starts
    per = -(-size // PASSAGE)
    if not per.sum():
        return np.zeros((0, PASSAGE), np.uint16)
    text = np.repeat(np.arange(len(upto)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    at = (starts[text] + nth * PASSAGE)[:, None] + np.arange(PASSAGE)
    out = np.where(at < upto[text][:, None], terms[np.minimum(at, len(terms) - 1)], TERMS).astype(np.uint16)
    out.sort(axis=1)
    return out


def _first(p: np.ndarray) -> np.ndarray:
    """Marks the first of equal terms in a sorted passage."""
    f = p < TERMS
    f[:, 1:] &= p[:, 1:] != p[:, :-1]
    return f


def tree_sum(parts: DataFrame, kind: np.dtype, fan: int = 8) -> np.ndarray | None:
    """The sum of arrays in binary column x, one per task, added in a tree; at most ``fan`` reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                x = np.frombuffer(v.as_buffer(), kind)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    n = parts.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.repartitionById(n, F.floor(F.spark_partition_id() / fan).cast("int")).mapInArrow(add, "x binary")  # each task adds ``fan`` arrays
    total = None
    for r in parts.collect():
        x = np.frombuffer(r.x, kind)
        total = x.copy() if total is None else total + x
    return total


def frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TERMS + 1, np.int64)
        for b in batches:
            for _, ids, upto in _kept(b.column(0)):
                p = _passages(_term(ids), upto)
                n[:TERMS] += np.bincount(p[_first(p)], minlength=TERMS)[:TERMS]
                n[TERMS] += len(p)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], ["x"])

    total = tree_sum(words.mapInArrow(run, "x binary"), np.dtype(np.int64))
    return (total[:TERMS], int(total[TERMS])) if total is not None else (np.zeros(TERMS, np.int64), 0)


def _tfidf(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(1 + log tf) idf at the first of equal terms of each sorted passage, scaled to length one; 0 elsewhere."""
    first = _first(p)
    place = np.flatnonzero(first)
    stop = np.append(place[1:], p.size)
    row = place // PASSAGE
    # Equal terms end where the next term begins; the last term of a row before its blanks.
    filled = (p < TERMS).sum(1)
    tf = np.minimum(stop, row * PASSAGE + filled[row]) - place
    w = np.zeros(p.shape, np.float32)
    w.ravel()[place] = _LOGS[tf] * weight[p.ravel()[place]]
    w /= np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-12)[:, None]
    return w


_LOGS = np.append(0, 1 + np.log(np.arange(1, PASSAGE + 1))).astype(np.float32)


def _omega(rank: int, seed: int) -> np.ndarray:
    omega = np.random.default_rng(seed).normal(size=(TERMS + 1, rank)).astype(np.float32)
    omega[TERMS] = 0
    return omega


def sketch(words: DataFrame, idf: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """A^T (A Omega), terms by rank, over all passages."""
    weight = np.append(idf, 0).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _omega(rank, seed)
        total = np.zeros((rank, TERMS + 1))
        for b in batches:
            for _, ids, upto in _kept(b.column(0)):
                p = _passages(_term(ids), upto)
                if not len(p):
                    continue
                w = _tfidf(p, weight)
                y = np.matmul(w[:, None, :], omega[p])[:, 0].T.copy()
                place = np.flatnonzero(w)
                term, row, w = p.ravel()[place].astype(np.int64), place // PASSAGE, w.ravel()[place]
                for k in range(rank):
                    total[k] += np.bincount(term, w * y[k][row], TERMS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total[:, :TERMS].astype(np.float32).tobytes()], pa.binary())], ["x"])

    total = tree_sum(words.mapInArrow(run, "x binary"), np.dtype(np.float32))
    return np.zeros((TERMS, rank)) if total is None else total.reshape(rank, TERMS).T.astype(np.float64)


def singular_vectors(c: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors of A over their singular values, from C = A^T A Omega (Nystrom: A^T A is about C (Omega^T C)^-1 C^T)."""
    omega = _omega(c.shape[1], seed)[:TERMS].astype(np.float64)
    core = omega.T @ c
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-12)
    u, s, _ = np.linalg.svd(c @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    u, s = u[:, :rank], s[:rank]
    u, s = u[:, s > 1e-9 * max(s.max(initial=0), 1e-12)], s[s > 1e-9 * max(s.max(initial=0), 1e-12)]
    skip = SKIP if len(s) > 4 * SKIP else 0
    return u[:, skip:] / s[skip:]


def lcs(a: np.ndarray, b: np.ndarray, masks: dict | None = None) -> int:
    """Length of the longest common subsequence, a bit for each place of ``a``."""
    if masks is None:
        masks = lcs_masks(a)
    full = (1 << len(a)) - 1
    s = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = s & m
            s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def lcs_masks(a: np.ndarray) -> dict:
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    return masks


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    masks: dict
    answer: np.ndarray


def answer_of(words: np.ndarray) -> np.ndarray:
    """An item's answer: its last fifth, three words at least."""
    return words[-max(3, len(words) // 5) :]


def _window_sums(sums: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Sums over n blocks from every block on, from those over fewer that ``sums`` holds; it keeps the new ones."""
    if n not in sums:
        a = 1 << (n.bit_length() - 1)
        a = a // 2 if a == n else a
        x = _window_sums(sums, a).copy()
        if a < len(x):
            x[:-a] += _window_sums(sums, n - a)[a:]
        sums[n] = x
    return sums[n]


class Retrieval:
    """Windows of texts against items in the latent space, then the exact checks."""

    def __init__(self, items: list[tuple[object, np.ndarray]], vectors: np.ndarray, idf: np.ndarray, cosine: float, full: float, part: float, answer: float):
        self.project = np.zeros((TERMS + 1, vectors.shape[1]), np.float32)
        self.project[:TERMS] = vectors * idf[:, None]
        self.cosine, self.full, self.part, self.answer = cosine, full, part, answer
        self.items = [Item(i, w, lcs_masks(w), answer_of(w)) for i, w in items]
        self.mine = np.zeros(1 << 16, bool)  # marks the words of the item at hand
        groups: dict[int, list[int]] = {}
        for k, it in enumerate(self.items):
            groups.setdefault(next((w for w in WINDOWS if w >= len(it.words)), WINDOWS[-1]), []).append(k)
        self.by_window: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, ks in sorted(groups.items()):
            z = np.stack([self.project[_term(self.items[k].words)].sum(0) for k in ks])
            self.by_window[w] = (np.array(ks), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12))

    def _windows(self, z: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Sums of z over windows of each wanted number of blocks, from every block on; beyond the end nothing is added."""
        sums = {1: z}
        for w in self.by_window:
            yield w, _window_sums(sums, w // STEP)

    def search(self, ids: np.ndarray, upto: np.ndarray) -> Iterator[tuple[int, int, float, float, bool]]:
        """(text, item, cosine, share of the item in the common subsequence, answer found) of every match."""
        starts = np.concatenate(([0], upto[:-1]))
        blocks = -(-(upto - starts) // STEP)
        first = np.cumsum(blocks) - blocks
        n = int(blocks.sum())
        if not n:
            return
        text = np.repeat(np.arange(len(upto)), blocks)
        nth = np.arange(n) - first[text]
        begin = starts[text] + nth * STEP
        at = begin[:, None] + np.arange(STEP)
        term = np.where(at < upto[text][:, None], _term(ids)[np.minimum(at, len(ids) - 1)], TERMS)
        z = self.project[term[:, 0]]
        for k in range(1, STEP):
            z += self.project[term[:, k]]
        best: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for w, v in self._windows(z):
            ks, items = self.by_window[w]
            own = np.flatnonzero(nth % max(1, w // 4 // STEP) == 0)
            v = v[own]
            c = v @ items.T
            c /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
            col, row = np.nonzero(c.T >= self.cosine)
            cuts = np.flatnonzero(np.diff(col)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(col))) if len(col) else ():
                k, rows = int(ks[col[lo]]), row[lo:hi]
                it, a = self.items[k], begin[own[rows]]
                slack, d = len(it.words) // 2, text[own[rows]]
                at = a.astype(np.int32)[:, None] + np.arange(-slack, w + slack, dtype=np.int32)
                inside = (at >= starts[d][:, None]) & (at < upto[d][:, None])
                self.mine[it.words] = True
                enough = (self.mine[ids[np.clip(at, 0, len(ids) - 1)]] & inside).sum(1) >= self.part * len(it.words)
                self.mine[it.words] = False
                # Where fewer words agree than any common subsequence needs, there is none.
                for x, y, z in zip(d[enough].tolist(), a[enough].tolist(), c[rows[enough], col[lo]].tolist()):
                    best.setdefault((x, k), []).append((z, y, min(y + w, int(upto[x]))))
        for (d, k), found in sorted(best.items()):
            it = self.items[k]
            slack = len(it.words) // 2
            for c, a, z in sorted(found, reverse=True):
                near = ids[max(a - slack, int(starts[d])) : min(z + slack, int(upto[d]))]
                share = lcs(it.words, near, it.masks) / len(it.words)
                if share < self.part:
                    continue
                told = lcs(it.answer, near) >= self.answer * len(it.answer)
                if share >= self.full or told:
                    yield d, k, c, share, told
                    break


def matches(
    docs: DataFrame, benchmark: DataFrame, rank: int = 48, oversample: int = 8, cosine: float = 0.45, full: float = 0.8, part: float = 0.6,
    answer: float = 0.8, least_words: int = 5, most_items: int = 100_000, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_found for every document and item it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_found boolean"
    tmp = Scratch(spark, "decontaminate")
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size.n // most_items), -(-(size.bytes or 0) // most_bytes))
    own = benchmark.select("item_id", "text").where("text is not null")
    if parts > 1:  # numbered once, so that every item is in one part, repeated ones too
        own = tmp.write(own.withColumn("part", F.monotonically_increasing_id() % parts), "items")
    model, found = None, []
    for k in range(parts):
        items, short = [], []
        for r in (own.where(F.col("part") == k) if parts > 1 else own).collect():
            raw = np.frombuffer(r.text.encode("utf-8", "surrogatepass"), np.uint8)
            h, _ = words_of(raw, np.array([len(raw)]))
            if len(h) >= least_words:
                items.append((r.item_id, _id(h)))
            elif len(h):
                short.append((r.item_id, h))
        if items:
            if model is None:
                kept = tmp.write(word_ids(docs, id_col, text_col), "words")
                df, passages = frequencies(kept.select("words"))
                idf = np.log((passages + 1) / (df + 1)) + 0.1
                model = singular_vectors(sketch(kept.select("words"), idf, rank + oversample), rank), idf
            found.append(kept.mapInArrow(_searching(Retrieval(items, *model, cosine, full, part, answer)), schema))
        if short:
            found.append(sequences(docs, short, schema, id_col, text_col))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _searching(search: Retrieval):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for lo, ids, upto in _kept(b.column(1)):
                for d, k, c, share, told in search.search(ids, upto):
                    rows.append(lo + d)
                    out.append((search.items[k].item_id, c, share, told))
            if rows:
                item, c, share, told = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(item), pa.array(c), pa.array(share), pa.array(told)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"])

    return run


def sequences(docs: DataFrame, items: list[tuple[object, np.ndarray]], schema: str, id_col: str, text_col: str) -> DataFrame:
    """Matches of items that are short sequences of word hashes, in the columns of ``matches``."""
    by_length: dict[int, dict[tuple, list[object]]] = {}
    for i, h in items:
        by_length.setdefault(len(h), {}).setdefault(tuple(h.tolist()), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for lo, _, h, upto in _slices(b.column(1)):
                for n, wanted in by_length.items():
                    at = np.flatnonzero(np.isin(h, np.array([w[0] for w in wanted], np.uint64)))
                    d = np.searchsorted(upto, at, "right")
                    at, d = at[at + n <= upto[d]], d[at + n <= upto[d]]
                    seen = set(zip(d.tolist(), map(tuple, h[at[:, None] + np.arange(n)].tolist())))
                    for k, ws in sorted(seen):
                        rows += [lo + k] * len(wanted.get(ws, ()))
                        out += wanted.get(ws, ())
            if rows:
                one = pa.array([1.0] * len(rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(out), pa.nulls(len(rows), pa.float64()), one, pa.array([True] * len(rows))],
                    ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
