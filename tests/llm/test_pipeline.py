import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tarnlake.llm import pii
from tarnlake.llm.common import Scratch

from .test_packing import best_fit, check

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that went into and came out of each stage."""
    tmp, docs, out = Scratch(spark, "test"), spark.read.parquet(f"{D}/documents.parquet"), {}
    for name, f in cp.STAGES:
        made = tmp.write(f(spark, docs, D), name)
        out[name] = (docs, made)
        docs = made
    return out


def test_columns(stages):
    for name, (docs, made) in stages.items():
        if name != "packing":
            assert made.columns == docs.columns and made.schema == docs.schema


def test_language_keeps_documents_with_letters(stages):
    docs, made = stages["language"]
    kept = {r.doc_id for r in made.collect()}
    gone = [r for r in docs.collect() if r.doc_id not in kept]
    assert len(gone) < 10 and all(len(re.findall(r"[^\W\d_]", r.text or "")) < 10 for r in gone)


def test_near_duplicates_leave_one_of_equal_texts(stages):
    docs, made = stages["near_duplicates"]
    texts = Counter(r.text for r in docs.collect())
    assert max(texts.values()) > 1
    left = Counter(r.text for r in made.collect())
    assert max(left.values()) == 1
    assert len(left) > 0.85 * len(texts)


def test_near_duplicates_keep_one_row_of_each_group(spark, docs_of):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (5, a + " end"), (7, a), (None, a), (8, b), (8, b), (9, c), (None, None), (None, None), (3, ""), (3, ""), (None, "x y z"), (8, c)]
    docs = docs_of(rows).withColumn("stays", F.lit(1)).withColumn("key", F.lit("k"))
    out = cp.near_duplicates(spark, docs, D)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "")[:1]) for r in out.collect())
    assert got == sorted([(5, "a"), (8, "b"), (8, "c"), (0, ""), (0, ""), (3, ""), (3, ""), (0, "x")])
    assert cp.near_duplicates(spark, docs.limit(0), D).count() == 0


def test_decontamination_takes_items_out(spark, stages):
    docs, made = stages["decontamination"]
    norm = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    held = {r.doc_id for r in docs.collect() if any(i in norm(r.text) for i in items)}
    kept = {r.doc_id for r in made.collect()}
    assert held and kept == {r.doc_id for r in docs.collect()} - held


def test_personal_data_equals_plain_rewrite(stages):
    docs, made = stages["personal_data"]
    new = {r.doc_id: r for r in made.collect()}
    for r in docs.collect():
        want, spans = pii.replace(r.text, cp.KEY)
        assert new[r.doc_id].text == want and new[r.doc_id].n_chars == (len(want) if spans else r.n_chars)


def test_packing(stages):
    docs, made = stages["packing"]
    rows = made.collect()
    assert check(rows, {r.doc_id: r.text for r in docs.collect()}) == best_fit([r.length for r in rows], 4096)


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "the and of that is to"), (3, "the and of that is to"), (4, "x " * 40000), (5, None)]
    for docs in (docs_of(rows), docs_of([])):
        tmp = Scratch(spark, "edges")
        for name, f in cp.STAGES:
            docs = tmp.write(f(spark, docs, D), name)
    assert docs.count() == 0
