"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Only the order of suffixes by their first ``length`` (200) bytes matters.  They
are never all in one place; one bounded bucket of suffixes is sorted at a time:

1. A filter: positions modulo v in a difference cover are the sample, and for any
   two suffixes some shift below v brings both into the sample, so a repeat of
   200 bytes shows as a repeat of 200 - v + 1 bytes at sampled positions.  Only
   suffixes near a recurring sample (by 32-bit fingerprint) stay; equal strings
   have equal fingerprints, so none is lost.
2. A suffix's bucket is that of the least gram (by hash, grams of 16 bytes) among
   its 200 bytes: equal strings share a bucket, and neighbouring suffixes mostly
   do too, so a run of them travels as one piece of text, about three bytes for
   each suffix.  Only one gram in 16 is counted and, unless it recurs very often,
   comes first in that order.  Around a frequent passage no such gram may be left;
   there all grams are counted and the frequent ones come last, so suffixes that
   reach over its edge are dealt by what stands beside it.
3. A bucket is sorted by its text: sample suffixes of a second cover first get ranks
   by doubling; all suffixes are sorted by their first v bytes, longer ties are
   merged by the ranks of the pair's shared shift, and by the last bytes that ranks
   do not reach.  Neighbours that compare equal are equal byte by byte.  A bucket
   of much text is sorted in parts, each of whole grams, as sorting takes some 100
   bytes of memory for each byte.

Equal pieces of text go once per chunk to their bucket, with a mark if they recur
there, so a string with a third of all places is no burden to its bucket.

Texts are cut into chunks of whole documents in a table that is bucketed by part,
a few chunks of one writing task; answers come back to their chunk by a join
that moves answers only.  Chunks are rows of megabytes, so their files have row
groups of few: readers hold a row group at once, however much a task was given.

Edge cases: null and empty texts have no bytes; equal texts of at least 200 bytes
vanish whole; strings never cross documents; repeated rows are documents of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches


def difference_cover(q: int) -> tuple[int, list[int]]:
    """v = q^2 + q + 1 and q + 1 residues whose differences are all residues: a plane's line, for a prime q.

    The powers of a root of a cubic over the field of q elements, taken modulo
    scalars, run through all points of the plane; those on one line are a cover.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, line = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        line.append(i)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(line) == q + 1 and len({(i - j) % v for i in line for j in line}) == v:
                    return v, line
    raise ValueError(f"no line found for {q}")


def cover_for(length: int) -> tuple[int, list[int]]:
    """The widest cover that leaves at least a quarter of the length to the sample's keys."""
    for q in (11, 7, 5, 3, 2):
        if q * q + q + 1 <= length * 3 // 4:
            return difference_cover(q)
    return 1, [0]


class Powers:
    """A fingerprint drawn from a seed: a value for each byte, a base, and its powers and their inverses, grown as needed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) & ~7 | 5
        self.bytes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[:1] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


class Text:
    """The bytes of a chunk and the fingerprints of its substrings."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, powers: Powers):
        self.data, self.sizes = data, sizes
        self.ends = np.cumsum(sizes)
        n = len(data)
        self.up, self.down = powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(powers.bytes[data] * self.up[:n], out=self.sums[1:])

    def end_of(self, at: np.ndarray) -> np.ndarray:
        """End of the document that holds each place."""
        return self.ends[np.searchsorted(self.ends, at, "right")]

    def key(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[at + length] - self.sums[at]) * self.down[at])

    def grams(self, m: int) -> np.ndarray:
        """The fingerprint of m bytes at every place that has so many behind it in the chunk."""
        n = max(0, len(self.data) - m + 1)
        return _mixed((self.sums[m : m + n] - self.sums[:n]) * self.down[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Keys:
    """The distinct keys of one round in a chunk, in order of bucket and key, and where each stands."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray):
        order = np.argsort(key)
        order = order[np.argsort(bucket[order], kind="stable")]  # a radix sort where buckets fit 16 bits
        b, k = bucket[order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.bucket, self.key = b[new], k[new]
        self.many = np.diff(np.append(np.flatnonzero(new), len(order))) > 1  # recurs within the chunk

    def blobs(self) -> Iterator[tuple[int, bytes, bytes]]:
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for own in np.split(np.arange(len(self.bucket)), cuts) if len(self.bucket) else ():
            yield int(self.bucket[own[0]]), self.key[own].tobytes(), np.packbits(self.many[own]).tobytes()

    def answered(self, answers) -> np.ndarray:
        """Per place: is its key repeated anywhere."""
        again = np.zeros(len(self.bucket), bool)
        own = self.bucket.astype(np.int64)
        for a in answers or ():
            lo, hi = np.searchsorted(own, [a["bucket"], a["bucket"] + 1])
            again[lo:hi] = np.unpackbits(np.frombuffer(a["again"], np.uint8))[: hi - lo]
        return again[self.place]


#: What is sent for each piece of text: its size, and more of its gram's hash than the bucket says.
PIECE = np.dtype([("size", "<i4"), ("part", "<u2")])


class Runs:
    """Candidate suffixes of a chunk as runs of neighbours with one bucket, and the distinct pieces of text they need."""

    def __init__(self, t: Text, at: np.ndarray, bucket: np.ndarray, least: np.ndarray, length: int, longest: int = 256):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1]) | (np.diff(np.searchsorted(t.ends, at, "right")) != 0)
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= since % longest == 0
        starts = np.flatnonzero(new)
        self.at, self.count = at, np.diff(np.append(starts, len(at)))
        raw = t.data.tobytes()
        known: dict[bytes, int] = {}
        self.piece = np.empty(len(starts), np.int64)
        for r, (a, c) in enumerate(zip(at[starts].tolist(), self.count.tolist())):
            self.piece[r] = known.setdefault(raw[a : a + c - 1 + length], len(known))
        first = np.empty(len(known), np.int64)
        first[self.piece[::-1]] = starts[::-1]
        self.pieces, self.bucket = list(known), bucket[first] if len(known) else np.zeros(0, np.int64)
        self.head = np.empty(len(known), PIECE)
        self.head["size"], self.head["part"] = [len(x) for x in known], _mixed(least[first]) >> np.uint64(48)
        self.many = np.bincount(self.piece, minlength=len(known)) > 1
        self.order = np.argsort(self.bucket, kind="stable")
        self.length = length

    def blobs(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(bucket, texts, their heads, their marks)."""
        b = self.bucket[self.order]
        for own in np.split(self.order, np.flatnonzero(np.diff(b)) + 1) if len(b) else ():
            texts = [self.pieces[k] for k in own.tolist()]
            yield int(self.bucket[own[0]]), b"".join(texts), self.head[own].tobytes(), np.packbits(self.many[own]).tobytes()

    def answered(self, answers) -> np.ndarray:
        """The candidates that are repeated."""
        size = np.array([len(x) - self.length + 1 for x in self.pieces], np.int64)
        size = size[self.order]
        stop = np.cumsum(size)
        bits = np.zeros(stop[-1] if len(stop) else 0, bool)
        b = self.bucket[self.order]
        for a in answers or ():
            lo, hi = np.searchsorted(b, [a["bucket"], a["bucket"] + 1])
            if hi > lo:
                i, z = stop[lo] - size[lo], stop[hi - 1]
                bits[i:z] = np.unpackbits(np.frombuffer(a["again"], np.uint8))[: z - i]
        start = np.empty(len(size), np.int64)
        start[self.order] = stop - size
        from_ = np.repeat(start[self.piece] - (np.cumsum(self.count) - self.count), self.count)
        return self.at[bits[from_ + np.arange(len(self.at))]]


def _covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Places in [s, s + width) of any start; starts may begin before 0."""
    d = np.bincount(np.clip(starts, 0, n), minlength=n + 1) - np.bincount(np.clip(starts + width, 0, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def _around(starts: np.ndarray, width: int) -> np.ndarray:
    """Places in [s, s + width) of any start, for ascending starts."""
    if not len(starts):
        return np.zeros(0, np.int64)
    size = np.append(np.minimum(np.diff(starts), width), width)
    stop = np.cumsum(size)
    return np.arange(stop[-1]) + np.repeat(starts - (stop - size), size)


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    if len(g) < width:
        return g[:0]
    k, a = 1, g
    while 2 * k <= width:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    n = len(g) - width + 1
    return np.minimum(a[:n], a[width - k : width - k + n])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which are in a sorted array."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Rounds:
    """What a chunk asks in each round, given the answers of the rounds before."""

    #: One gram in so many may be frequent enough to be counted; only those are chosen where there is one.
    ANCHORS = 16

    def __init__(self, length: int, buckets: tuple[int, int], seed: int = 0, hot: np.ndarray | None = None, worn: np.ndarray | None = None):
        self.length, self.buckets = length, buckets
        self.v, self.cover = cover_for(length)
        self.gram = max(1, min(16, length // 3))
        self.hot = np.zeros(0, np.uint64) if hot is None else hot
        self.worn = np.zeros(0, np.uint64) if worn is None else worn
        self.powers = Powers(seed)

    def samples(self, t: Text) -> tuple[np.ndarray, Keys]:
        n, short = len(t.data), self.length - self.v + 1
        at = (np.arange(0, n, self.v)[:, None] + np.array(self.cover)).ravel()
        at = at[at < n]
        at = at[at + short <= t.end_of(at)]
        h = t.key(at, short)
        b = (h >> np.uint64(32)) % np.uint64(self.buckets[0])
        return at, Keys(b.astype(np.uint16 if self.buckets[0] <= 1 << 16 else np.int32), h.astype(np.uint32))

    def candidates(self, t: Text, answers) -> np.ndarray:
        """Suffixes near a recurring sample, with ``length`` bytes in their document."""
        s, keys = self.samples(t)
        s = s[keys.answered(answers)]
        w = _around(s - self.v + 1, self.v)
        w = w[np.searchsorted(w, 0) :]
        return w[w + self.length <= t.end_of(w)] if len(w) else w

    def anchors(self, t: Text, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The grams of the candidates that are counted, each with its places."""
        h = t.key(_around(w, self.length - self.gram + 1), self.gram)
        return np.unique(h[h & np.uint64(self.ANCHORS - 1) == 0], return_counts=True)

    def _least(self, t: Text, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The grams around candidates, their order, the candidates' least; the first grams of those without an infrequent anchor, and which these are."""
        width = self.length - self.gram + 1
        at = _around(w, width)
        h = t.key(at, self.gram)
        anchor = np.flatnonzero(h & np.uint64(self.ANCHORS - 1) == 0)
        anchor = anchor[~_among(h[anchor], self.hot)]
        g = _mixed(h) | np.uint64(1 << 63)
        g[anchor] &= np.uint64((1 << 63) - 1)
        first = np.searchsorted(at, w)  # a candidate's grams are neighbours here too
        least = _least(g, width)[first]
        bare = np.flatnonzero(least >> np.uint64(63))
        return h, g, least, first[bare], bare

    def bare(self, t: Text, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All grams of the candidates without an infrequent anchor, each with its places."""
        h, _, _, first, _ = self._least(t, w)
        return np.unique(h[_around(first, self.length - self.gram + 1)], return_counts=True)

    def runs(self, t: Text, w: np.ndarray) -> Runs:
        h, g, least, first, bare = self._least(t, w)
        if len(bare) and len(self.worn):
            width = self.length - self.gram + 1
            near = _around(first, width)
            x = g[near] & ~np.uint64(1 << 62)
            x[_among(h[near], self.worn)] |= np.uint64(1 << 62)
            least[bare] = _least(x, width)[np.searchsorted(near, first)]
        return Runs(t, w, (_mixed(least) % np.uint64(self.buckets[1])).astype(np.int64), least, self.length)


def recurring(blobs: list[np.ndarray], many: list[np.ndarray]) -> list[np.ndarray]:
    """For every key of every blob: does it recur."""
    key = np.concatenate(blobs)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    marked = (np.bincount(group, np.concatenate(many)[order]) > 0) | (np.bincount(group) > 1)
    again = np.empty(len(k), bool)
    again[order] = marked[group]
    return np.split(again, np.cumsum([len(b) for b in blobs])[:-1])


def _sort_words(at: np.ndarray, words: np.ndarray, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the places by the words at these offsets, and the group of equals of each in that order."""
    order = np.argsort(words[at + offsets[0]])
    w = words[at[order] + offsets[0]]
    new = np.ones(len(at), bool)
    new[1:] = w[1:] != w[:-1]
    for o in offsets[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        own = order[idx]
        w = words[at[own] + o]
        group = np.cumsum(new)[idx]
        by = np.argsort(w)
        by = by[np.argsort(group[by], kind="stable")]
        order[idx], w = own[by], w[by]
        new[idx[1:]] |= w[1:] != w[:-1]  # groups stay where they were, so a new one keeps its mark
    return order, np.cumsum(new) - 1


class Bucket:
    """The suffixes of one bucket, sorted by their first ``length`` bytes.

    ``text`` holds distinct pieces end to end; ``at`` are the suffixes, each with
    ``length`` bytes in its piece.
    """

    def __init__(self, text: np.ndarray, at: np.ndarray, length: int):
        self.at, self.length = at, length
        fit = [q for q in (3, 2) if 2 * (q * q + q + 1) <= length]
        self.v, self.cover = difference_cover(fit[0]) if fit else (1, [0])
        padded = np.zeros(len(text) + length + 16, np.uint8)
        padded[: len(text)] = text
        w = padded.astype(np.uint64)
        for k in (1, 2, 4):
            w = (w[:-k] << np.uint64(8 * k)) | w[k:]
        self.words, self.n = w, len(text)
        self.reach = self.v * ((length - self.v + 1) // self.v)  # bytes by which samples are ranked
        self.rank = self._ranks()
        held = np.zeros(self.v, bool)
        held[self.cover] = True
        r = np.arange(self.v)
        self.shift = np.zeros((self.v, self.v), np.int64)
        for d in range(self.v - 1, -1, -1):
            on = held[(r + d) % self.v]
            self.shift[on[:, None] & on[None, :]] = d
        self.tail = self._offsets(length - self.reach, self.reach)

    def _offsets(self, size: int, start: int = 0) -> list[int]:
        """Words that together hold ``size`` bytes from ``start`` on (only whole words, at most overlapping)."""
        if size < 8:
            return [start + k for k in range(size)]
        return [start + k for k in range(0, size - 7, 8)] + ([start + size - 8] if size % 8 else [])

    def _word(self, at: np.ndarray, offset: int, size: int) -> np.ndarray:
        w = self.words[at + offset]
        return w >> np.uint64(56) if size < 8 else w

    def _by_text(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        words = self.words if size >= 8 else self.words >> np.uint64(56)
        return _sort_words(at, words, self._offsets(size))

    def _ranks(self) -> np.ndarray:
        """Rank of every sample by ``reach`` bytes, by doubling; places past a piece's end are never asked for."""
        s = (np.arange(0, self.n, self.v)[:, None] + np.array(self.cover)).ravel()
        s = s[s < self.n]
        rank = np.zeros(self.n + self.length + 1, np.int64)
        order, group = self._by_text(s, self.v)
        rank[s[order]] = group + 1
        have, want = 1, self.reach // self.v
        while have < want:
            step = min(have, want - have)
            key = rank[s] * np.int64(len(s) + 2) + rank[s + step * self.v]
            order = np.argsort(key)
            k = key[order]
            rank[s[order]] = np.cumsum(np.append(True, k[1:] != k[:-1]))
            have += step
        return rank

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0, 1 for suffixes that share their first v bytes."""
        d = self.shift[i % self.v, j % self.v]
        out = np.sign(self.rank[i + d] - self.rank[j + d]).astype(np.int8)
        same = np.flatnonzero(out == 0)
        for o in self.tail:
            if not len(same):
                break
            a, b = (self._word(x[same], o, self.length - self.reach) for x in (i, j))
            out[same] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            same = same[a == b]
        return out

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes, and for each in that order whether it equals the one before."""
        order, group = self._by_text(self.at, self.v)
        x = self.at[order]
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        g = group[tied]
        first = np.searchsorted(g, g)  # where each one's group begins among the tied
        stop = first + size[g]
        width = 1
        pos = np.arange(len(tied))
        item = np.arange(len(tied))  # which of the tied stands at each place
        xs = x[tied]
        while len(pos) and width < int((stop - first).max()):
            go = pos[(stop - first)[pos] > width]
            lane = (go - first[go]) // width
            left = lane % 2 == 0
            base = first[go] + (lane - lane % 2) * width
            mid, end = np.minimum(base + width, stop[go]), np.minimum(base + 2 * width, stop[go])
            lo, hi = np.where(left, mid, base), np.where(left, end, mid)
            other = lo.copy()
            mine = xs[item[go]]
            while len(open_ := np.flatnonzero(lo < hi)):
                m = (lo[open_] + hi[open_]) >> 1
                c = self.compare(xs[item[m]], mine[open_])
                after = (c < 0) | ((c == 0) & ~left[open_])  # left goes first among equals
                lo[open_[after]] = m[after] + 1
                hi[open_[~after]] = m[~after]
            place = go + (lo - other) - np.where(left, 0, mid - base)
            moved = item.copy()
            moved[place] = item[go]
            item = moved
            width *= 2
        order[tied] = order[tied[item]]
        x = self.at[order]
        same = np.zeros(len(x), bool)
        k = np.flatnonzero(group[1:] == group[:-1]) + 1
        same[k] = self.compare(x[k - 1], x[k]) == 0
        return order, same


def sort_bucket(pieces: list[bytes], many: np.ndarray, length: int) -> list[np.ndarray]:
    """For every piece, which of its suffixes are repeated: within it, in another, or because the piece recurs."""
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(p, len(known)) for p in pieces], np.int64)
    marked = (np.bincount(of) > 1) | (np.bincount(of, many) > 0)
    size = np.array([len(p) for p in known], np.int64)
    count = size - length + 1
    stop = np.cumsum(count)
    at = np.repeat(np.cumsum(size) - size - (stop - count), count) + np.arange(stop[-1])
    order, same = Bucket(np.frombuffer(b"".join(known), np.uint8), at, length).sorted()
    again = np.repeat(marked, count)
    hit = same.copy()
    hit[:-1] |= same[1:]
    # one mark of a recurring piece holds for all suffixes equal to its own; those are repeated in any case
    again[order[hit]] = True
    parts = np.split(again, stop[:-1])
    return [parts[k] for k in of.tolist()]


def _answer_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    blobs = [np.frombuffer(b, np.uint32) for b in pdf["keys"]]
    many = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(b)] for m, b in zip(pdf["many"], blobs)]
    out = pdf[["part", "seq", "bucket"]].copy()
    out["again"] = [np.packbits(a).tobytes() for a in recurring(blobs, many)]
    return out


#: Bytes of text that are sorted at once, but for one gram's own.
SORTED_BYTES = 1 << 18


def sort_in_parts(pieces: list[bytes], part: np.ndarray, many: np.ndarray, length: int) -> list[np.ndarray]:
    """``sort_bucket`` in turn for parts of the bucket, each of at most SORTED_BYTES or of one value of ``part``."""
    order = np.argsort(part, kind="stable")
    size = np.array([len(pieces[k]) for k in order.tolist()], np.int64)
    edge = np.flatnonzero(np.diff(part[order])) + 1
    cuts, held, lo = [], 0, 0
    for hi, n in zip([*edge.tolist(), len(order)], np.add.reduceat(size, np.append(0, edge)).tolist()):
        if held and held + n > SORTED_BYTES:
            cuts.append(lo)
            held = 0
        held, lo = held + n, hi
    out: list = [None] * len(pieces)
    for own in np.split(order, cuts):
        for k, bits in zip(own.tolist(), sort_bucket([pieces[k] for k in own.tolist()], many[own], length)):
            out[k] = bits
    return out


def _answer_pieces(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, many, part, held = [], [], [], []
        for blob, heads, marks in zip(pdf["texts"], pdf["sizes"], pdf["many"]):
            head = np.frombuffer(heads, PIECE)
            size = head["size"]
            ends = np.cumsum(size).tolist()
            pieces += [blob[z - n : z] for z, n in zip(ends, size.tolist())]
            many.append(np.unpackbits(np.frombuffer(marks, np.uint8))[: len(size)])
            part.append(head["part"])
            held.append(len(size))
        bits = sort_in_parts(pieces, np.concatenate(part), np.concatenate(many), length)
        out, k = pdf[["part", "seq", "bucket"]].copy(), 0
        again = []
        for n in held:
            again.append(np.packbits(np.concatenate(bits[k : k + n])).tobytes())
            k += n
        out["again"] = again
        return out

    return run


#: Chunks of one part, whose answers are gathered in one row, and of one row group, which is read at once.
PART_CHUNKS, GROUP_CHUNKS = 8, 4


def chunked(docs: DataFrame, tmp: Scratch, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, str]:
    """The texts as a table of chunks (part, seq, ids, sizes, data), bucketed by part, up to PART_CHUNKS of a writing task."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, sizes, parts, held = [], [], [], 0

        def chunk():
            part, seq = divmod(made, PART_CHUNKS)
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | part], pa.int64()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                ["part", "seq", "ids", "sizes", "data"],
            )

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if held and held + len(raw) > chunk_bytes:
                    yield chunk()
                    made += 1
                    ids, sizes, parts, held = [], [], [], 0
                ids.append(i)
                sizes.append(len(raw))
                parts.append(raw)
                held += len(raw)
        if ids:
            yield chunk()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chunks = rows.mapInArrow(run, f"part long, seq int, ids array<{kind}>, sizes array<long>, data binary")
    name = f"tarnlake_chunks_{uuid.uuid4().hex[:12]}"
    n = min(50_000, 3 * max(4, rows.rdd.getNumPartitions()))
    groups = {"parquet.block.row.count.limit": GROUP_CHUNKS}
    chunks.write.bucketBy(n, "part").format("parquet").options(path=f"{tmp.root}/chunks", compression="zstd", **groups).saveAsTable(name)
    return spark.table(name), name


def repeated(docs: DataFrame, length: int = 200, chunk_bytes: int = 2 << 20, bucket_keys: int = 1 << 20, bucket_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, length of each maximal removed run, in bytes).

    ``bucket_keys`` bounds the filter's buckets, ``bucket_bytes`` the text of a sorted one, both on average.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "suffixes")
    chunks, name = chunked(docs, tmp, id_col, text_col, chunk_bytes)
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    v, cover = cover_for(length)
    buckets = (int(max(8, total * len(cover) / v // bucket_keys + 1)), int(max(8, 3 * total // bucket_bytes + 1)))
    kind = docs.schema[id_col].dataType.simpleString()
    known: list[DataFrame] = []
    seed = secrets.randbits(128)  # one for all rounds of this run

    def joined() -> DataFrame:
        """Chunks with the answers of the rounds so far; only answers are moved."""
        df = chunks
        for r, a in enumerate(known):
            df = df.join(a.withColumnRenamed("answers", f"a{r}").hint("shuffle_hash"), "part", "left")
        mine = [F.element_at(f"a{r}", F.col("seq")).alias(f"a{r}") for r in range(len(known))]
        return df.select("part", "seq", "ids", "sizes", "data", *mine)

    def answers(told: DataFrame, name: str) -> DataFrame:
        by_chunk = told.groupBy("part", "seq").agg(F.collect_list(F.struct("bucket", "again")).alias("answers"))
        by_part = by_chunk.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("seq", "answers"))).alias("answers"))
        return tmp.write(by_part, name)

    def texts(batches: Iterator[pa.RecordBatch], rounds: Rounds):
        for b in batches:
            for k in range(b.num_rows):
                t = Text(np.frombuffer(b.column(4)[k].as_buffer(), np.uint8), np.array(b.column(3)[k].as_py(), np.int64), rounds.powers)
                yield b, k, t, [c[k].as_py() or [] for c in b.columns[5:]]

    def rows(b, k: int, got: list, kinds: list, names: list) -> pa.RecordBatch:
        here = [pa.array(np.full(len(got), b.column(c)[k].as_py(), kind)) for c, kind in enumerate((np.int64, np.int32))]
        return pa.RecordBatch.from_arrays(here + [pa.array(c, t) for c, t in zip(zip(*got), kinds)], ["part", "seq", *names])

    def grams(counted: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counted[0].view(np.int64)), pa.array(counted[1], pa.int64())], ["gram", "n"])

    def frequent(count, least: int, name: str) -> np.ndarray:
        """The grams with more than ``least`` places; at most 2^21, 16 MB, for which ``least`` may have to grow."""
        counted = joined().mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        found = tmp.write(counted.where(F.col("n") > least), name)
        while found.where(F.col("n") > least).count() > 1 << 21:
            least *= 2
        got = found.where(F.col("n") > least).select("gram").toPandas()["gram"].to_numpy(np.int64)
        return np.sort(got.view(np.uint64))

    def ask_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(length, buckets, seed)
        for b, k, t, _ in texts(batches, rounds):
            if got := list(rounds.samples(t)[1].blobs()):
                yield rows(b, k, got, [pa.int32(), pa.binary(), pa.binary()], ["bucket", "keys", "many"])

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(length, buckets, seed)
        for _, _, t, told in texts(batches, rounds):
            yield grams(rounds.anchors(t, rounds.candidates(t, told[0])))

    def count_bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(length, buckets, seed, hot)
        for _, _, t, told in texts(batches, rounds):
            yield grams(rounds.bare(t, rounds.candidates(t, told[0])))

    def ask_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(length, buckets, seed, hot, worn)
        for b, k, t, told in texts(batches, rounds):
            if got := list(rounds.runs(t, rounds.candidates(t, told[0])).blobs()):
                yield rows(b, k, got, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "texts", "sizes", "many"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(length, buckets, seed, hot, worn)
        for b, k, t, told in texts(batches, rounds):
            places = rounds.runs(t, rounds.candidates(t, told[0])).answered(told[1])
            gone = _covered(len(t.data), places, length)
            edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
            starts = t.ends - t.sizes
            on = np.union1d(np.flatnonzero(edge > 0), starts[(t.sizes > 0)][gone[starts[t.sizes > 0]]])  # a run ends with its document
            off = np.union1d(np.flatnonzero(edge < 0), t.ends[t.sizes > 0][gone[t.ends[t.sizes > 0] - 1]])
            lo, hi = np.searchsorted(on, starts), np.searchsorted(on, t.ends)
            hi = np.where(t.sizes > 0, hi, lo)
            found = []
            for d, (a, z) in enumerate(zip(starts.tolist(), t.ends.tolist())):
                keep = t.data[a:z] if hi[d] == lo[d] else t.data[a:z][~gone[a:z]]
                spans = [{"start": int(x - a), "length": int(y - x)} for x, y in zip(on[lo[d] : hi[d]], off[lo[d] : hi[d]])]
                found.append((z - a, z - a - len(keep), len(spans), hashlib.sha256(keep).hexdigest(), spans))
            n, r, s, sha, spans = zip(*found)
            ids = b.column(2)[k].values
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(sha), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # chunks, not documents
    try:
        asked = joined().mapInArrow(ask_keys, "part long, seq int, bucket int, keys binary, many binary")
        known.append(answers(asked.groupBy("bucket").applyInPandas(_answer_keys, "part long, seq int, bucket int, again binary"), "answers-0"))
        often = max(1, bucket_bytes // (8 * length))
        hot = frequent(count_anchors, often, "anchors")
        worn = frequent(count_bare, often, "bare")
        asked = joined().mapInArrow(ask_pieces, "part long, seq int, bucket int, texts binary, sizes binary, many binary")
        known.append(answers(asked.groupBy("bucket").applyInPandas(_answer_pieces(length), "part long, seq int, bucket int, again binary"), "answers-1"))
        out = tmp.write(joined().mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>"), "spans")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        tmp.drop("chunks", "answers-0", "answers-1", "anchors", "bare")
    return out
