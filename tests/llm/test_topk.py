import math

import numpy as np

from tarnlake.llm import queries, topk

from .oracle import rows_of, sql_rows


def brute(rows, k, every):
    """Every row against every other, in Python's integers."""
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (q, x) in enumerate(ok):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for m, (c, y) in enumerate(ok) if m != n and len(y) == len(x))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def found(df, **kwargs):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, **kwargs).collect())


def test_small_shards_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + 0.05 * rng.normal(size=8) * (i % 3)).tolist()) for i in range(900)]
    rows += [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1050, [float("inf")] + [0.0] * 7), (1100, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, dist double")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, 5, 50)
    for name, value in (("ANNULUS", 4), ("BANDS", 3), ("SHARD", 16), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(topk, name, value)
    assert found(df, pivots=8) == want
    assert found(df, pivots=1) == want


def test_repeated_rows_are_candidates_of_each_other(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(32)] + [(0, [3.0, 0.0, 0.0, 0.0])] * 3 + [(0, [0.0] * 4)] * 7
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, pivots=4) == brute(rows, 5, 50)


def test_large_components_and_other_lengths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(topk, "ANNULUS", 8)
    rows = [(i, (rng.normal(size=6) * 10.0 ** (i % 8)).tolist()) for i in range(200)]
    rows += [(200 + i, rng.normal(size=3 + i % 2).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, pivots=4, every=10) == brute(rows, 5, 10)


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e12, 0.0]), (2, [2e12, 0.0]), (3, [-1e12, 0.0]), (4, [0.0, 5.0]), (5, [-2e12, 0.0]), (6, [1e307, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top, low = 2**63 - 1, -(2**63) + 1
    assert found(df, k=6) == [(0, 1, 6, top), (0, 2, 2, top), (0, 3, 1, top), (0, 4, 4, 256 * 1280), (0, 5, 3, low), (0, 6, 5, low)]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(0, 1, 1, 128 * 256)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert topk.top_k(one).count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    assert rows_of(queries.op8_pivot_topk(spark, d)) == sql_rows(queries.ORACLES["op8_pivot_topk"], d)


def test_bounds_prune():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(20, 8)), 50, 0) + rng.normal(size=(1000, 8)) / 256
    s = topk.scaled(x, 256.0)
    p = s[::50]
    d = topk._distances(s, p)
    own = d.argmin(1)
    annuli = []
    for k in range(20):
        c = np.flatnonzero(own == k)
        c = c[np.argsort(d[c, k])]
        annuli += [topk.annulus(k, d[a, k], a, a, x[a], 256.0) for a in np.array_split(c, 3) if len(a)]
    q = topk.Search(np.arange(10), x[:10], 5, 256.0)
    pivot = [a["pivot"] for a in annuli]
    scanned = topk.search_blocks(q, d[:10][:, pivot], (s[:10] @ p.T)[:, pivot], annuli)
    assert scanned < 10 * len(annuli) / 2
