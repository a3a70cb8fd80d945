"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs; all but the last return the columns of
documents.  Null and empty texts, repeated rows and empty tables pass through as
the operators define; a row with a null id is kept where a stage filters by id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import decontaminate, langid, packing, pii, simhash_trie
from tarnlake.llm.common import Scratch, scratch_scope, table

KEY = b"tarnlake public example key"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; goes: no letter at all, or two languages about equally near.

    The classifiers learn from every document of the stage with a language.
    """
    return langid.known_language(docs, langid.train(docs, F.lit(True)), ambiguous=0.05)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are alike (five-word shingles, Jaccard 0.8): the one with the smallest id.

    Texts without words are no copies of anything.
    """
    rows = simhash_trie.near_copies(docs, words=5, similarity=0.8).where("fp <> 0").groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    rows = rows.join(rows.groupBy("root").agg(F.min(own).alias("first")), "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    rows = rows.withColumn("__stays", stays).where("not __stays or n > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__stays")
    told = docs.join(rows, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    repeated = told.where("__stays").dropDuplicates(["__id", "__key"])  # rows that recur whole; nothing else is shuffled for it
    return told.where("__stays is null").unionByName(repeated).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; n_chars follows the new text."""
    out = pii.rewrite(docs, KEY)
    if "n_chars" in out.columns:
        kind = docs.schema["n_chars"].dataType
        changed = (F.size("pii") > 0) & F.col("n_chars").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("pii")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The stages learn, hash and tokenise; SQL cannot express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    tmp = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch_scope(tmp):  # what the operators kept for this stage goes once its rows are written
            docs = tmp.write(stage(spark, docs, sf_dir), name)
        if k:
            tmp.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
