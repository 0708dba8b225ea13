"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, ordered last; an
empty table, or one without words, gives targets of 0. Rows that repeat an id are documents of their own; rows that repeat
an id and a text draw the same place and are taken one after the other. Ties between draws go by id and digest. Very long
texts are counted whole. Columns other than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, written

EPOCHS = 3
WEIGHTS = (1, 2, 3)
BUCKET_DIGITS = 3  # hexadecimal: 4096 buckets of a source
SEED = 20240607


def word_count(text: Column) -> Column:
    """The number of runs of ``[^\\x20\\x09-\\x0D]`` in ``text``, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: int = EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """``sources`` (key, source, source_size) with target: min(epochs x size, level x weight), summing to all words.

    Sources are taken in the order in which they reach their cap; the level is that of the first which does not. That is
    the fixed point of clamping and sharing the excess out by weight. One row per source goes through this window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    filling = Window.orderBy("at", "rank")
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(filling.rowsBetween(0, Window.unboundedFollowing))
    found = capped.withColumn("level", level)
    reached = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(reached, F.lit(float("inf"))) * F.col("weight"))
    return found.withColumn("target", target).select("key", "source_size", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    epochs: int = EPOCHS,
    weights: tuple = WEIGHTS,
    seed: int = SEED,
    cut: bool = True,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies (whole repetitions taken), row_key.

    Each document is taken a whole number of times; a further, seeded share of documents is taken once more until the
    source's target is met. The last of those is taken as far as its words are needed (``cut``), or else as a whole
    document if at least half of it is needed.
    """
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col))).alias("key"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
    ).withColumn("draw", F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_key"))))
    # The bucket is the leading part of the draw: buckets in order, then draws in order, are one seeded order of a source.
    rows = written(narrow.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS)), "mix-rows")
    buckets = rows.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    sources = buckets.groupBy("key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    filled = water_fill(sources, epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        buckets.join(filled, "key")
        .withColumn("whole", whole)
        .withColumn("more", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .withColumn(
            "before",
            F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bucket_size"),
        )
        .select("key", "bucket", "source_size", "target", "whole", "more", "before")
    )
    inside = Window.partitionBy("key", "bucket").orderBy("draw", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(inside) - F.col("size")
    left = F.col("more") - F.col("upto")
    extra = (
        F.greatest(F.lit(0), F.least(F.col("size"), left))
        if cut
        else F.when((left * 2 >= F.col("size")) & (left > 0), F.col("size")).otherwise(F.lit(0))
    )
    return (
        rows.join(plan, ["key", "bucket"])
        .withColumn("upto", upto)
        .withColumn("extra", extra.cast("long"))
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
            (F.col("whole") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
            "row_key",
        )
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).drop("copies", "row_key")


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         coalesce('i' || doc_id, 'n') || '|' || coalesce(sha256(text), 'n') AS row_key FROM documents),
s AS (
  SELECT key, sum(size)::DOUBLE AS source_size, ((row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY key),
c AS (SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / weight AS mark FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY mark, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY mark, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT key, source_size, least(cap, (SELECT max(level) FROM l WHERE level <= mark) * weight) AS target FROM l),
w AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY key ORDER BY md5('20240607|' || row_key), row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS upto
  FROM d JOIN t USING (key))
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (whole * size + greatest(0, least(size, round(target - whole * source_size) - upto)))::BIGINT AS taken
FROM w
"""
