"""Exact top-k inner products by a pivot-distance index.

Vectors are scaled to integers.  Each vector is keyed by its nearest pivot and
its distance to it; the vectors of a pivot, in order of distance, are cut into
annuli, which know their least and greatest distance and their greatest norm N.
For a query and an annulus [low, high] of pivot p the triangle inequality bounds
the distance from below by t = max(0, d(q,p) - high, low - d(q,p)), and with
2 q.x = |q|^2 + |x|^2 - |q - x|^2 the score from above by (|q|^2 + N^2 - t^2) / 2;
q.p + |q| high and |q| N are bounds too, and the least counts.

The index has two levels.  At most 64 wide annuli a pivot are rows of a table.
A query first goes to the annulus with the highest bound, which gives its k-th
best score a floor, and then to the others whose bound reaches that floor; an
index row goes to its one annulus.  There, annuli of 256 rows are expanded from
the highest bound down until the bound is under the k-th best score.  A task holds one annulus (a
larger one is dealt over shards by hash) and streams its queries.  Bounds carry
slack for rounding and only strictly lower ones stop a search, so ties are whole.

Scores are exact integers whatever the size of the components: products run in
doubles where no partial sum can pass 2^53, in 64-bit integers up to 2^62, in
Python's integers beyond.  A score outside a long is returned as the nearest long
and ordered by how far outside it is, in double precision.

Edge cases: vectors that are null, empty, or hold null or non-finite components
take no part; vectors of another length have no inner product with a query and
are no candidates of it, but are searched among their own; a query leaves out its
own row alone, so repeated rows are candidates of each other and queries of their
own; ties go to the smaller id, then to any order among equal ids; a null id takes
no part; fewer than k others give all; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample

ANNULUS = 256
#: Wide annuli of a pivot, at most; vectors of one that a task holds; queries that share a copy of it.
BANDS, SHARD, QUERY_BLOCK = 64, 1 << 16, 1 << 18


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """rid (one per row), id, dim, x (doubles, not scaled yet); only vectors that take part."""
    v = F.col(vec_col)
    x = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), v.cast("array<double>").alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return x.where("id is not null and x is not null and dim > 0").where(~F.exists("x", bad))


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); a finite component that leaves the doubles becomes infinite here, which only loosens bounds."""
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def _whole(x: np.ndarray, scale: float) -> np.ndarray:
    """The same as Python's integers, exact at any size."""
    one = lambda c: math.floor(scale * c) if abs(c) < 1e200 else int(c) * int(scale)
    return np.array([[one(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.sqrt(np.maximum(d, 0))


def choose_pivots(x: DataFrame, pivots: int, sample: int, scale: float) -> np.ndarray:
    """Pivots from a bounded, documented sample: the ``sample`` rows of least hash; k-means++ like spread, then three refinements."""
    s = scaled(np.array([r.x for r in bounded_sample(x, sample, "rid").select("x").collect()]), scale)
    s = s[np.isfinite(_norms(s))]
    if not len(s):
        return np.zeros((1, 1))
    take = [0]
    near = ((s - s[0]) ** 2).sum(1)
    while len(take) < min(pivots, len(s)) and near.max() > 0:
        take.append(int(near.argmax()))
        near = np.minimum(near, ((s - s[take[-1]]) ** 2).sum(1))
    p = s[take]
    for _ in range(3):
        own = _distances(s, p).argmin(1)
        p = np.array([s[own == k].mean(0) if (own == k).any() else p[k] for k in range(len(p))])
    return p


_NONE = np.iinfo(np.int64).min


class Search:
    """The k best of a block of queries: rid and id of a candidate, score, and what a score has beyond a long."""

    def __init__(self, rid: np.ndarray, raw: np.ndarray, k: int, scale: float, floor: np.ndarray | None = None):
        self.rid, self.raw, self.k, self.scale = rid, raw, k, scale
        self.x = scaled(raw, scale)
        self.norm = _norms(self.x)
        n = len(rid)
        self.floor = np.full(n, _NONE) if floor is None else floor
        self.best = {"rid": np.full((n, k), -1), "id": np.zeros((n, k), np.int64), "score": np.full((n, k), _NONE), "over": np.zeros((n, k))}

    def threshold(self, rows=slice(None)) -> np.ndarray:
        """What a score must reach; the least long where everything counts."""
        full = self.best["rid"][rows, -1] >= 0
        return np.maximum(self.floor[rows], np.where(full, self.best["score"][rows, -1], _NONE))

    def products(self, rows: np.ndarray, annulus: dict) -> tuple[np.ndarray, np.ndarray | None]:
        """Exact scores; every partial sum of a product is at most the product of the norms."""
        most = self.norm[rows].max() * annulus["norm"]
        if most < 1 << 53:
            return (self.x[rows] @ annulus["x"].T).astype(np.int64), None
        if most < 1 << 62:
            return self.x[rows].astype(np.int64) @ annulus["x"].T.astype(np.int64), None
        exact = _whole(self.raw[rows], self.scale) @ _whole(annulus["raw"], self.scale).T
        top, low = np.iinfo(np.int64).max, _NONE + 1
        score = np.clip(exact, low, top)
        far = lambda v: float(v) if abs(v) < 1 << 1000 else (math.inf if v > 0 else -math.inf)
        return score.astype(np.int64), np.array([far(v) for v in (exact - score).ravel()]).reshape(score.shape)

    def scan(self, rows: np.ndarray, annulus: dict) -> None:
        score, over = self.products(rows, annulus)
        own = self.rid[rows][:, None] == annulus["rid"][None]
        score[own] = _NONE
        least = self.threshold(rows)
        if score.shape[1] > self.k:  # only the annulus's own k best, ties included, can enter
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((score >= least[:, None]) & ~own)
        if not len(r):
            return
        busy = np.unique(r)
        old, place = np.nonzero(self.best["rid"][rows[busy]] >= 0)
        held = rows[busy][old]
        new = {"rid": annulus["rid"][c], "id": annulus["id"][c], "score": score[r, c], "over": np.zeros(len(r)) if over is None else over[r, c]}
        query = np.append(busy[old], r)
        own = {n: np.append(v[held, place], new[n]) for n, v in self.best.items()}
        order = np.lexsort((own["rid"], own["id"], -own["over"], ~own["score"], query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = (a[rank < self.k] for a in (order, query, rank))
        for n, v in self.best.items():
            v[rows[query], rank] = own[n][order]


def annulus(pivot: int, dist: np.ndarray, ids: np.ndarray, rids: np.ndarray, raw: np.ndarray, scale: float) -> dict:
    """One block of the index; ``dist`` is sorted."""
    x = scaled(raw, scale)
    return {"pivot": pivot, "low": dist[0], "high": dist[-1], "norm": float(_norms(x).max()), "id": ids, "rid": rids, "raw": raw, "x": x}


def search_blocks(q: Search, to_pivot: np.ndarray, dot_pivot: np.ndarray, annuli: list[dict]) -> int:
    """Expand sorted annuli for every query; returns how many query-annulus pairs were scanned.

    to_pivot, dot_pivot: distance and inner product of each query with each annulus's pivot.
    """
    if not annuli or not len(q.rid):
        return 0
    low, high, norm = (np.array([a[n] for a in annuli]) for n in ("low", "high", "norm"))
    with np.errstate(over="ignore", invalid="ignore"):
        n = q.norm[:, None]
        near = np.fmax(0, np.fmax(to_pivot - high, low - to_pivot) * (1 - 1e-9) - 1e-3)
        bound = np.fmin(np.fmin((n * n + norm * norm - near * near) / 2, n * norm), dot_pivot + n * high)
        bound = np.nan_to_num(bound + 1e-9 * (np.abs(bound) + n * norm) + 1e-3 * (1 + n), nan=np.inf, posinf=np.inf, neginf=np.inf)
    turn = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(q.rid))
    scanned = 0
    for r in range(len(annuli)):
        at = turn[live, r]
        go = bound[live, at] >= q.threshold(live)  # bounds only fall from here on
        live, at = live[go], at[go]
        if not len(live):
            break
        scanned += len(live)
        for a in np.unique(at):
            q.scan(live[at == a], annuli[a])
    return scanned


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_FOUND = "query_rid long, query_id long, rid long, vec_id long, score long, over double"


def _meet(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Rows in order of (cell, shard, block, tag): a cell's vectors, then its queries, which stream."""
    key, held, annuli = None, [], None

    def built() -> list[dict]:
        """The cell's vectors as annuli of ANNULUS rows, in order of distance."""
        rid, ids, dist, raw = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(dist, kind="stable")
        cuts = (order[at : at + ANNULUS] for at in range(0, len(order), ANNULUS))
        return [annulus(0, dist[c], ids[c], rid[c], raw[c], scale) for c in cuts]

    for b in batches:
        if not b.num_rows:
            continue
        cell, shard, block, tag, rid, ids, pivot, dist, floor = (b.column(i).to_numpy(zero_copy_only=False) for i in range(9))
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (shard[1:] != shard[:-1]) | (block[1:] != block[:-1]) | (tag[1:] != tag[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
            if (cell[lo], shard[lo], block[lo]) != key:
                key, held, annuli = (cell[lo], shard[lo], block[lo]), [], None
            raw = _vectors(b.column(9).slice(lo, hi - lo))
            if tag[lo] == 0:
                held.append((rid[lo:hi], ids[lo:hi], dist[lo:hi], raw))
                continue
            if annuli is None:
                annuli = built() if held else []
            q = Search(rid[lo:hi], raw, k, scale, floor[lo:hi])
            p = pivots[pivot[lo]] if pivot[lo] >= 0 else np.zeros(raw.shape[1])
            with np.errstate(over="ignore", invalid="ignore"):
                search_blocks(q, _distances(q.x, p[None]), (q.x @ p)[:, None], annuli)
            r, c = np.nonzero(q.best["rid"] >= 0)
            if len(r):
                own = [q.best[n][r, c] for n in ("rid", "id", "score", "over")]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (q.rid[r], ids[lo:hi][r], *own)], ["query_rid", "query_id", "rid", "vec_id", "score", "over"])


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_rid").orderBy(F.desc("score"), F.desc("over"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, pivots: int = 64, sample: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``, against all other rows."""
    spark = vectors.sparkSession
    tmp = Scratch(spark, "topk")
    x = tmp.write(_usable(vectors, id_col, vec_col), "x")
    facts = x.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not facts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n = facts[0].dim, facts[0].n
    probe = choose_pivots(x.where(F.col("dim") == dim), pivots, sample, scale)  # at most `pivots` vectors
    if probe.shape[1] != dim:
        probe = np.zeros((1, dim))
    bands = int(min(BANDS, max(1, n // (len(probe) * ANNULUS))))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nearest pivot and distance; vectors of another length have the origin alone, as pivot -1. Queries keep all distances."""
        for b in batches:
            if not b.num_rows:
                continue
            size, ids = b.column(2).to_numpy(), b.column(1).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                v = scaled(_vectors(b.column(3).take(pa.array(at))), scale)
                norm = _norms(v)
                pivot, dist, far = np.full(len(at), -1, np.int32), norm, [None] * len(at)
                if d == dim:
                    to = np.nan_to_num(_distances(v, probe), nan=np.inf)
                    pivot = to.argmin(1).astype(np.int32)
                    dist = to[np.arange(len(at)), pivot]
                    far = [t if i % every == 0 else None for t, i in zip(to, ids[at])]
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pivot), pa.array(dist), pa.array(norm), pa.array(far, pa.list_(pa.float64()))], [*b.schema.names, "pivot", "dist", "norm", "far"])

    index = tmp.write(x.mapInArrow(key, "rid long, id long, dim int, x array<double>, pivot int, dist double, norm double, far array<double>"), "index")
    # Wide annuli: edges at quantiles of the distance, then what each holds.
    edges = index.groupBy("dim", "pivot").agg(F.percentile_approx("dist", [i / bands for i in range(1, bands)] or [1.0], 1000).alias("edges"))
    band = F.size(F.filter("edges", lambda e: e < F.col("dist"))) if bands > 1 else F.lit(0)
    banded = index.join(edges, ["dim", "pivot"]).withColumn("band", band).drop("edges")
    cells = banded.groupBy("dim", "pivot", "band").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("most"), F.count("*").alias("n"))
    cells = tmp.write(cells.coalesce(1).withColumn("cell", F.monotonically_increasing_id()).withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int")), "cells")
    p2 = F.lit([float(v) for v in (probe * probe).sum(1)])

    queries = index.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    # The bound of every query and wide annulus: the table of annuli has at most BANDS rows for each pivot.
    d = F.when(F.col("c.pivot") >= 0, F.element_at("q.far", F.col("c.pivot") + 1)).otherwise(F.col("q.norm"))
    q2 = F.col("q.norm") * F.col("q.norm")
    near = F.greatest(F.lit(0.0), d - F.col("high"), F.col("low") - d) * (1 - 1e-9) - 1e-3
    near = F.greatest(F.lit(0.0), near)
    dot = (q2 + F.when(F.col("c.pivot") >= 0, F.element_at(p2, F.col("c.pivot") + 1)).otherwise(0.0) - d * d) / 2
    bound = F.least((q2 + F.col("most") * F.col("most") - near * near) / 2, F.col("q.norm") * F.col("most"), dot + F.col("q.norm") * F.col("high"))
    bound = bound + 1e-9 * (q2 + F.col("most") * F.col("most") + d * d) + 1e-3 * (1 + F.col("q.norm"))
    routes = queries.alias("q").join(cells.alias("c"), F.col("q.dim") == F.col("c.dim")).select(
        "q.rid", "q.id", "q.x", "c.cell", "c.shards", F.col("c.pivot"), bound.alias("bound")
    )

    def meet(to: DataFrame) -> DataFrame:
        """Queries (rid, id, x, cell, shards, pivot, floor) meet the vectors of their annuli."""
        asked = to.select("cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block.alias("block"), F.lit(1).alias("tag"), "rid", "id", "pivot", F.lit(0.0).alias("dist"), "floor", "x")
        held = banded.join(cells.select("dim", "pivot", "band", "cell", "shards"), ["dim", "pivot", "band"]).select(
            "cell", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
            F.lit(0).alias("tag"), "rid", "id", "pivot", "dist", F.lit(int(_NONE)).alias("floor"), "x",
        )
        rows = held.unionByName(asked).repartition("cell", "shard", "block").sortWithinPartitions("cell", "shard", "block", "tag")
        return rows.mapInArrow(lambda it: _meet(it, probe, k, scale), _FOUND)

    first = routes.groupBy("rid").agg(F.max_by(F.struct("id", "x", "cell", "shards", "pivot"), F.struct("bound", "cell")).alias("f"))
    first = tmp.write(first.select("rid", "f.*", F.lit(int(_NONE)).alias("floor")), "first")
    seeds = tmp.write(_best(meet(first), k).drop("rank"), "seeds")
    floors = seeds.groupBy(F.col("query_rid").alias("rid")).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    floors = first.select("rid", F.col("cell").alias("seed")).join(floors, "rid", "left").withColumn("floor", F.coalesce("floor", F.lit(int(_NONE))))
    rest = routes.join(floors, "rid").where((F.col("cell") != F.col("seed")) & (F.isnan("bound") | (F.col("bound") >= F.col("floor").cast("double"))))
    found = seeds.unionByName(meet(rest))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
