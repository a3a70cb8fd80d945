import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnlake.llm import queries, toxicity


def test_machine_learns_a_pair():
    rng = np.random.default_rng(3)
    x = (rng.random((3000, 12)) < 0.3).astype(float)
    y = ((x[:, 0] * x[:, 1]) > 0).astype(float)  # neither term alone
    rows = [np.flatnonzero(r) for r in x]
    m = toxicity.Machine(np.arange(12)).fit(rows[:2400], y[:2400], epochs=60, l2=1e-4)
    p = m.score(x[2400:]) > 0.5
    assert (p == y[2400:]).mean() > 0.97
    s = np.array([[i == j for j in range(12)] for i in (0, 1)], float)
    both = s.sum(0, keepdims=True)
    assert m.raw(both)[0] > m.raw(s).max() + 1


def test_raw_equals_pairs():
    m = toxicity.Machine(np.arange(6), rank=3)
    rng = np.random.default_rng(1)
    m.w, m.v, m.b = rng.normal(size=6), rng.normal(size=(6, 3)), 0.3
    x = np.array([[1, 0, 1, 1, 0, 1.0]])
    on = np.flatnonzero(x[0])
    want = m.b + m.w[on].sum() + sum(m.v[i] @ m.v[j] for i in on for j in on if i < j)
    assert np.isclose(m.raw(x)[0], want)


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "you idiot"), (4, "nice day"), (5, "idiot " * 40000), (4, "nice day")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (2, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.scored(docs, m).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), m).count() == 0


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op6_factorization_toxicity(spark, d).collect()
    assert len(rows) == 10000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert np.mean([p for p, t in held if t]) > 0.8 and np.mean([p for p, t in held if not t]) < 0.02


def test_least_counts_on_small_tables(spark):
    from pyspark.sql import functions as F

    from tarnlake.llm import toxicity

    texts = [(i, "plain words here" + (" vilest" if i < 20 else "") + (" rarely" if i < 5 else "")) for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i, _ in texts], "doc_id long, toxic int")
    two, eight = (set(toxicity.train(docs, labels, F.lit(True), least=n).keep.tolist()) for n in (2, 8))
    assert eight and eight < two
