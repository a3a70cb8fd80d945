import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnlake.llm import quality, queries


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(4)
    d = quality.STATS
    x = [rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) for _ in range(2)]
    q = quality.Discriminant(np.array([400.0, 400.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), shrink=0.2, diagonal=0.1, floor=1e-4)
    own = [np.cov(v.T, bias=True) for v in x]
    pooled = (own[0] + own[1]) / 2
    logs = []
    for c in range(2):
        s = 0.8 * own[c] + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-4 * np.eye(d)
        z = x[0] - x[c].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose(q.score(x[0]), want, atol=1e-6)


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "a b c. d"), (4, "### $$$ | |"), (5, "word " * 30000), (3, "a b c. d"), (6, "e f g."), (7, "### %%%"), (8, "x")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(3, 1, 0), (6, 1, 0), (4, 0, 0), (7, 0, 0), (8, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for only, want in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        assert {r.score for r in quality.scored(docs, only, F.lit(True)).collect()} == {want}
    assert quality.scored(docs.limit(0), labels, F.lit(True)).count() == 0


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op9_quadratic_quality(spark, d).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == y[r.doc_id] for r in rows if r.held_out and r.doc_id in y]) > 0.93
