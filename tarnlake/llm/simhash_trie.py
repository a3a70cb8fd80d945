"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64-bit majority votes over the XXH64 values of word shingles.
Distinct fingerprints are joined with themselves: two that differ in at most
``radius`` bits agree exactly on one of ``radius + 1`` bit blocks, so the trie
is grown once per block with that block's bits on top.  The top levels carry no
error and are a shuffle key; below them each task walks pairs of trie nodes
together, adds up differing bits, and leaves a pair of nodes as soon as the
error budget is spent.  A task only keeps a spanning forest of the links it
finds, which has the same components; components are closed over all blocks by
alternating large-star and small-star steps, every step written to the shared
folder.

Edge cases: null and blank texts have fingerprint zero and link like any other;
equal texts share a fingerprint and so a component; rows with a null id take
part with the id left out of the minimum; repeated rows stay repeated; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import linked
from .common import Scratch, small_batches
from .components import connected

SEED = 42


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every shingle, repeats included; the whole sequence where it is shorter."""
    if not text:
        return np.zeros(0, np.uint64)
    ws = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the six ASCII blanks
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(ws) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(ws) - words + 1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority-vote fingerprint of one text; 0 without any word."""
    return majority(shingle_hashes(text, words))


def majority(hs: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    if not len(hs):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hs), 1 << 16):
        part = hs[at : at + (1 << 16)]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (votes * 2 > len(hs)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def trie_links(fps: np.ndarray, radius: int, leaf: int = 48) -> np.ndarray:
    """Spanning forest of the links among distinct uint64 fingerprints, as pairs of positions.

    Depth-first over pairs of node ranges in sorted order.  A node is a range of
    the sorted array sharing its top ``depth`` bits; a pair of nodes carries the
    number of bits in which their shared parts differ.
    """
    order = np.argsort(fps, kind="stable")
    f = fps[order]
    parent = np.arange(len(f))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []

    def halves(lo: int, hi: int, depth: int) -> tuple[tuple[int, int], tuple[int, int]]:
        bit = np.uint64(1) << np.uint64(63 - depth)
        cut = lo + int(np.searchsorted((f[lo:hi] & bit) != 0, True)) if hi > lo else lo
        return (lo, cut), (cut, hi)

    def jump(lo: int, hi: int, depth: int) -> int:
        """First depth at or below which the range still branches."""
        x = int(f[lo] ^ f[hi - 1])
        return max(depth, 64 - x.bit_length())

    def walk(radius: int) -> None:
        stack = [(0, len(f), 0, len(f), 0, 0)]
        while stack:
            a0, a1, b0, b1, depth, errors = stack.pop()
            if a0 >= a1 or b0 >= b1 or errors > radius:
                continue
            same = a0 == b0 and a1 == b1
            if same:
                if a1 - a0 < 2:
                    continue
                depth = jump(a0, a1, depth)
            if depth >= 64 or (a1 - a0) * (b1 - b0) <= leaf * leaf:
                near = np.bitwise_count(f[a0:a1, None] ^ f[None, b0:b1]) <= radius
                if near.any():  # what is linked already needs no further link
                    own, other = (np.array([find(i) for i in range(lo, hi)]) for lo, hi in ((a0, a1), (b0, b1)))
                    near &= own[:, None] != other
                i, j = np.nonzero(near)
                i, j = i + a0, j + b0
                if same:
                    i, j = i[i < j], j[i < j]
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = find(x), find(y)
                    if p != q:
                        parent[q] = p
                        out.append((x, y))
                continue
            (al, ah), (bl, bh) = halves(a0, a1, depth), halves(b0, b1, depth)
            stack.append((*al, *bl, depth + 1, errors))
            stack.append((*ah, *bh, depth + 1, errors))
            stack.append((*al, *bh, depth + 1, errors + 1))
            if not same:
                stack.append((*ah, *bl, depth + 1, errors + 1))

    # Near links first, so that the forest holds each group's nearest ones.
    for limit in sorted({*range(2, radius, 3), radius}):
        walk(limit)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return order[pairs]


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``parts`` blocks of ``width`` bits."""
    cuts = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _regrow(turned: np.ndarray, fixed: int, bits: int, at: int) -> np.ndarray:
    """Keep the top ``fixed`` bits and turn the rest of ``bits`` so that its bit ``at`` comes first."""
    if at == 0:
        return turned
    rest, zeros = bits - fixed, np.uint64(64 - bits)
    mask = np.uint64((1 << rest) - 1)
    low = (turned >> zeros) & mask
    low = ((low << np.uint64(at)) | (low >> np.uint64(rest - at))) & mask
    return (turned & ~(mask << zeros)) | (low << zeros)


def _grow(rows: DataFrame, radius: int, fixed: int, bits: int) -> tuple[DataFrame, int]:
    """Grow the trie below ``fixed`` error-free bits, once for each block on top."""
    blocks = _blocks(bits - fixed, radius + 1)
    least = min(w for _, w in blocks)

    def run(batches):
        for b in batches:
            path, x, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for k, (at, _) in enumerate(blocks):
                t = _regrow(x.view(np.uint64), fixed, bits, at)
                root = (t >> np.uint64(64 - fixed - least)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path * (radius + 1) + k), pa.array(root), pa.array(t.view(np.int64)), pa.array(fp)],
                    ["path", "root", "turned", "fp"],
                )

    return rows.select("path", "turned", "fp").mapInArrow(run, "path long, root long, turned long, fp long"), fixed + least


def links(distinct: DataFrame, tmp: Scratch, radius: int = 2, limit: int = 8192) -> DataFrame:
    """src, dst fingerprints: a forest of the links within ``radius`` bits, per trie root."""
    rows = distinct.select(F.lit(0).cast("long").alias("path"), F.col("fp").alias("turned"), "fp")
    grown, fixed = _grow(rows, radius, 0, 64)
    return _forest(grown, tmp, radius, fixed, 64, limit)


def _forest(grown: DataFrame, tmp: Scratch, radius: int, fixed: int, bits: int, limit: int = 8192) -> DataFrame:
    """src, dst: links of rows (path, root, turned, fp) with one path and root, ``fixed`` error-free bits.

    A root with more than ``limit`` rows grows again below its error-free bits, so
    what one task gathers is bounded and no pair is lost: after three growths from
    none, at radius 2, a root has 2**20 places at most.
    """
    found = []
    for level in range(3):
        counts = grown.groupBy("path", "root").agg(F.count("*").alias("n")).where("n > 1")
        busy = tmp.write(grown.join(counts, ["path", "root"]), f"roots-{level}")
        rows = busy.where(F.col("n") > limit)
        last = level == 2 or bits - fixed <= radius or rows.isEmpty()
        small = busy if last else busy.where(F.col("n") <= limit)
        lists = small.groupBy("path", "root").agg(F.collect_list(F.struct("turned", "fp")).alias("fs"))
        found.append(lists.select("fs.turned", "fs.fp").mapInPandas(lambda it: _walk(it, radius), "src long, dst long"))
        if last:
            break
        grown, fixed = _grow(rows, radius, fixed, bits)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _walk(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Walk the trie of each root with itself."""
    for pdf in batches:
        for turned, fp in zip(pdf["turned"], pdf["fp"]):
            t, fp = np.asarray(turned, np.int64).view(np.uint64), np.asarray(fp, np.int64)
            own, first, back = np.unique(t, return_index=True, return_inverse=True)
            p = first[trie_links(own, radius)]
            same = np.flatnonzero(first[back] != np.arange(len(t)))  # equal ones hang on the first
            src, dst = np.append(p[:, 0], first[back[same]]), np.append(p[:, 1], same)
            if len(src):
                yield pd.DataFrame({"src": fp[src], "dst": fp[dst]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that links reach."""
    tmp = Scratch(docs.sparkSession, "simhash")
    fp = tmp.write(fingerprints(docs, id_col, text_col, words), "fp")
    distinct = tmp.write(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return _components(fp, distinct, tmp.write(links(distinct, tmp, radius), "edges"), tmp).drop("root")


def _components(fp: DataFrame, distinct: DataFrame, edges: DataFrame, tmp: Scratch) -> DataFrame:
    """The rows ``fp`` (doc_id, fp, ...) with root (a component's least fingerprint) and component_id, from links between distinct fingerprints (fp, least)."""
    comp = connected(edges, tmp)  # (fingerprint, root) only for fingerprints with a link to another one
    named = distinct.select("fp", "least").join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left")
    linked = named.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = linked.join(least, "root").select("fp", "root", "component_id").unionByName(
        named.where("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    )
    by_fp = tmp.write(by_fp, "by_fp")
    return fp.join(by_fp, "fp").select(*fp.columns, "root", "component_id")


# -- near copies by similarity: wide fingerprints

#: Words of 64 bits in a wide fingerprint, and the odd factors that derive their hashes from a shingle's.
WIDE = 16
_ODD = np.random.default_rng(17).integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Each trie takes TRIE_BITS of the wide fingerprint, drawn anew: the top ones free of errors, the others with a budget.
TRIE_BITS, TRIE_ERRORS = 128, 30
#: Share of bits that differ at similarity 0.8, and the share of such pairs that no trie's top may keep together.
_DIFFER, _MISSED = 0.15, 0.0022
#: Rows of a trie root, and bytes of shingle sets, that a task holds at once (two such blocks at most).
ROOT_ROWS, FAMILY_BYTES = 1 << 14, 32 << 20


def tries_for(texts: int) -> tuple[int, int]:
    """Error-free bits on top of each trie and the number of tries.

    Roots hold a few thousand texts whatever the size of the table; more bits on
    top need more tries for the same recall.  From a million texts on, 12 bits grow.
    """
    top = max(12, (texts - 1).bit_length() - 8)
    return top, math.ceil(math.log(_MISSED) / math.log1p(-((1 - _DIFFER) ** top)))


def _drawn(tries: int) -> np.ndarray:
    """The bits of each trie, by a rule: tries of a smaller table are the first ones of a larger one's."""
    return np.stack([np.random.default_rng(23 + k).permutation(64 * WIDE)[:TRIE_BITS] for k in range(tries)])


def wide_fingerprint(hs: np.ndarray) -> bytes:
    """Majority bits of WIDE hashes derived from each distinct shingle's."""
    out = np.zeros(WIDE, np.uint64)
    hs = np.unique(hs)
    for k in range(WIDE):
        x = hs * _ODD[k]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[k] = majority(x ^ (x >> np.uint64(32)))
    return out.astype("<u8").tobytes()


def _tries(wides: pa.Array, drawn: np.ndarray) -> np.ndarray:
    """The bits of each trie of each wide fingerprint, as two words of 64."""
    bits = np.unpackbits(np.frombuffer(b"".join(w.as_py() for w in wides), np.uint8).reshape(len(wides), -1), axis=1)
    return np.packbits(bits[:, drawn], axis=2).view(">u8").astype(np.uint64)


def near_groups(x: np.ndarray, errors: int) -> list[np.ndarray]:
    """Groups of two or more fingerprints (rows of two words) that links of at most ``errors`` differing bits connect, every pair looked at."""
    a, b = np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])
    near = lambda i, j: np.bitwise_count(a[i, None] ^ a[j]) + np.bitwise_count(b[i, None] ^ b[j]) <= errors
    every, out = np.arange(len(x)), []
    left = every[np.concatenate([near(every[lo : lo + 256], every).sum(1) > 1 for lo in range(0, len(x), 256)])]
    while len(left):
        ahead, left = left[:1], left[1:]
        group = [ahead]
        while len(ahead) and len(left):
            hit = near(ahead[:256], left).any(0)
            group.append(left[hit])
            ahead, left = np.append(ahead[256:], left[hit]), left[~hit]
        out.append(np.concatenate(group))
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, fp, key (xxhash64 of the text), root, component_id: groups (of one root) of texts whose shingle sets have at least that Jaccard similarity.

    64 bits are too few for such a similarity: at 0.8 a tenth to a fifth of the
    bits differ.  So 1024 bits are voted on, and 40 tries (more on larger tables,
    see ``tries_for``) of 128 of them each are joined with themselves: bits on top
    without error, 30 errors below, where all pairs of a root are held against
    each other.  These links only say which texts to compare: in each of their
    components, texts are compared by their whole shingle sets, every two of them
    unless links of that similarity already connect them.  Large roots and large
    components are cut into blocks.  Texts without words are no copies of anything:
    each is a component of its own id, with fp 0.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "copies")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide, size = [], []
            for t in b.column(2):
                hs = np.unique(shingle_hashes(t.as_py(), words))
                wide.append(wide_fingerprint(hs) if len(hs) else None)
                size.append(len(hs))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(wide, pa.binary()), pa.array(size, pa.int64())], ["doc_id", "key", "wide", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), text).mapInArrow(run, f"doc_id {kind}, key long, wide binary, n long")
    made = tmp.write(rows.withColumn("fp", F.xxhash64("wide")), "made")
    blank = made.where("wide is null").select("doc_id", F.lit(0).cast("long").alias("fp"), "key", F.lit(0).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    made = made.where("wide is not null")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("wide", "key", "n")).alias("f"))  # a null id is no minimum
    distinct = tmp.write(distinct.select("fp", "least", "f.wide", "f.key", "f.n"), "distinct")
    top, tries = tries_for(max(2, distinct.count()))
    drawn = _drawn(tries)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = _tries(b.column(1), drawn)
            root = (np.arange(tries) << top) + (t[:, :, 0] >> np.uint64(64 - top)).astype(np.int64)
            fp = np.repeat(b.column(0).to_numpy(zero_copy_only=False), tries)
            high, low = (pa.array(t[:, :, k].ravel().view(np.int64)) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(root.ravel()), high, low, pa.array(fp)], ["grp", "high", "low", "fp"])

    grown = distinct.select("fp", "wide").mapInArrow(slices, "grp long, high long, low long, fp long").withColumn("weight", F.lit(1))
    near = linked(grown, tmp, "near", ROOT_ROWS, lambda part: part.select("grp", "block", "high", "low", "fp"), _near).distinct()
    edges = _compared(docs.select(F.xxhash64(text_col).alias("key"), text), distinct, near, tmp, words, similarity)
    return _components(made.select("doc_id", "fp", "key"), distinct, edges, tmp).unionByName(blank)


def _compared(texts: DataFrame, distinct: DataFrame, near: DataFrame, tmp: Scratch, words: int, least: float) -> DataFrame:
    """src, dst: links of similarity ``least`` within each component of ``near``, from whole shingle sets; texts are (key, text)."""
    family = connected(near, tmp, "family").select(F.col("node").alias("fp"), F.col("root").alias("grp"))
    weight = (F.col("n") * 8 + FAMILY_BYTES // 4096).alias("weight")
    family = tmp.write(family.join(distinct.select("fp", "key", "n"), "fp").select("grp", "fp", "key", weight), "families")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).astype("<u8").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["key", "shingles"])

    def load(part: DataFrame) -> DataFrame:
        sets = texts.join(part.select("key"), "key", "left_semi").select("key", "text").mapInArrow(run, "key long, shingles binary")
        sets = sets.groupBy("key").agg(F.first("shingles").alias("shingles"))  # of equal texts, one
        return part.join(sets, "key").select("grp", "block", "fp", "shingles")

    return linked(family, tmp, "alike", FAMILY_BYTES, load, lambda it: _alike(it, least))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The other columns of each run of equal values in the first two, which are in order."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        grp, block, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        cuts = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(grp)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and (grp[lo], block[lo]) != last:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            held.append([c[lo:hi] for c in rest])
            last = grp[lo], block[lo]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _links(fps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each group as links of its first to the others."""
    if fps:
        src, dst = np.concatenate([np.repeat(g[:1], len(g) - 1) for g in fps]), np.concatenate([g[1:] for g in fps])
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = [], 0
    for high, low, fp in _gathered(batches):
        if len(fp) < 2:
            continue
        own = [np.sort(fp[g]) for g in near_groups(np.stack([high, low], 1).view(np.uint64), TRIE_ERRORS)]
        found, n = found + own, n + sum(map(len, own))
        if n > 4096:
            yield from _links(found)
            found, n = [], 0
    yield from _links(found)


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for fp, sets in _gathered(batches):
        yield from _links([fp[g] for g in alike([np.frombuffer(x, "<u8") for x in sets], least)])


def alike(sets: list[np.ndarray], least: float) -> list[np.ndarray]:
    """Groups of two or more sets of distinct values that links of Jaccard similarity ``least`` connect, every pair looked at.

    Sets in order of size: those that can be so similar to one lie side by side.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    values, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ids = ids.astype(np.int32)
    start = np.concatenate(([0], np.cumsum(size)))
    mine, alone = np.zeros(len(values), np.int8), np.ones(len(sets), bool)
    out = []
    for first in range(len(sets)):
        if not alone[first]:
            continue
        alone[first] = False
        group, at = [first], 0
        while at < len(group):
            i, at = group[at], at + 1
            lo, hi = np.searchsorted(size, least * size[i] - 1e-6), np.searchsorted(size, size[i] / least + 1e-6, "right")
            others = np.flatnonzero(alone[lo:hi]) + lo
            mine[ids[start[i] : start[i + 1]]] = 1
            upto = np.cumsum(size[others])
            for k in np.split(others, np.searchsorted(upto, np.arange(1 << 22, upto[-1], 1 << 22))) if len(others) else ():
                if not len(k):
                    continue
                n, begin = size[k], np.cumsum(size[k]) - size[k]
                both = np.add.reduceat(mine[ids[np.repeat(start[k] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
                new = k[both / (n + size[i] - both) >= least]
                alone[new] = False
                group += new.tolist()
            mine[ids[start[i] : start[i + 1]]] = 0
        if len(group) > 1:
            out.append(order[group])
    return out
