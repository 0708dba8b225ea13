"""A corpus pipeline: each stage takes all documents that its predecessor kept and returns those that stay.

Language ID, exact dedup, SimHash near-dedup, mixing, and BPE coding. All stages but the last return the columns of
``documents``, extra ones included, whatever their names: columns that a stage needs for itself get names that are free.

Defined cases: rows without a letter (null and empty texts too) go with the first stage. Of rows that repeat an id and a
text, exact dedup keeps one. Ties are settled by doc_id: exact dedup keeps the largest, near-dedup the smallest. Very long
texts go through whole. A null doc_id, lang or source is a value like any other. Empty tables go through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import bpe, exact_dedup, lang_id, mixing, simhash
from cloakframe.llm.common import free_name, keep_rows, row_key, shared_dir, written

#: A text whose most likely language is no more likely than this is rejected, and so is one without a letter.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with no clear language; each row is decided where it lies."""
    pred, score = free_name(docs.columns, "pred"), free_name(docs.columns, "score")
    found = lang_id.annotate(docs, lang_id.train(docs), pred=pred, score=score)
    return found.where((F.col(pred) != lang_id.NONE) & (F.col(score) > LEAST_SCORE)).drop(pred, score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs).where("kept").select("row_key"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints keeps the row with the smallest doc_id."""
    groups = simhash.simhash_groups(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return keep_rows(docs, groups.where(stays).select("row_key"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents, some of them more than once (as repeated rows), until each source meets its target."""
    key, copies, copy = (free_name(docs.columns, base) for base in ("key", "copies", "copy"))
    took = mixing.mix(docs, cut=False).where("copies > 0")
    # Repeated rows of the input each have a plan of their own; the largest stands for all.
    plan = written(took.groupBy(F.col("row_key").alias(key)).agg(F.max("copies").alias(copies)), "mix-plan")
    joined = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(plan, key)
    each = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return joined.withColumn(copy, each).drop(key, copies, copy)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return bpe.digests(bpe.round_trip(docs, bpe.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mix),
    ("BPE", encode),
]

#: A trained network and 64-bit hashes decide what stays: not for SQL. tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
