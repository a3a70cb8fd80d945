import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnlake.llm import langid, queries


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 7, 12, 30):
        c = langid.codewords(n).astype(int)
        d = (c.shape[1] - c @ c.T) // 2
        assert c.shape[0] == n and (np.abs(c.sum(0)) < n).all() and d[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)


def test_edges(spark, docs_of):
    rows = [(1, "the cat sat on the mat and the dog"), (2, "der Hund und die Katze auf der Matte"), (3, None), (4, ""), (5, "123 !!"), (6, "the " * 40000), (6, "the the"), (8, "日本語"), (9, "É")]
    df = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 2, "de"))
    model = langid.train(df, F.lit(True))
    got = langid.identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].lang_pred == "en" and by[2].lang_pred == "de" and by[6].lang_pred == "en"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].ambiguous for k in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in got) and by[8].lang_pred in ("en", "de")
    assert langid.train(df, F.lit(False)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    one = langid.train(df.where("doc_id = 1"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(df.where("doc_id in (1, 8)"), one).collect()} == {"en"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op5_ecoc_langid(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
