"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, packing, pii, quality, simhash_trie, suffixes, topk, toxicity, url_filter
from .common import held_out, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The public vocabulary that packing uses.
VOCABULARY = "word_bpe_49k.json"


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 4096, 1)


@query
def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


ORACLES["op8_pivot_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: The four rules of the contract.
URL_RULES = [url_filter.Rule("block", "net/"), url_filter.Rule("allow", "example.net/en/"), url_filter.Rule("block", "example.com/de/"), url_filter.Rule("allow", "org/fr/")]


@query
def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or learned verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op5_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    found = langid.identify(docs, langid.train(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op9_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels not held out."""
    out = held_out(F.col("doc_id"), 5, 0)
    found = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels not held out."""
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~out))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Key of the registered query; a run of one's own passes its own secret.
PII_KEY = b"tarnlake public example key"


@query
def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by keyed pseudonyms."""
    out = pii.rewrite(table(spark, sf_dir, "documents"), PII_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct("pii.kind")), ",")
    return out.select("doc_id", "text", F.size("pii").alias("n_found"), kinds.alias("kinds"))


@query
def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings of 200 bytes."""
    return suffixes.repeated(table(spark, sf_dir, "documents")).drop("spans")


@query
def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with that item."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
