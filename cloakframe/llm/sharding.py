"""Sharding by longest-processing-time scheduling: groups of equal texts, largest first, go to the least-loaded shard.

Groups of one size are interchangeable, so the schedule only needs how many groups there are of each size. Sizes of groups
that add up to B bytes take at most sqrt(2 B) values: that histogram, and nothing else, comes to the driver, where a heap
(or, for many groups of a size, the closed form of what the heap would do) says how many of them each shard gets. Which
group is the k-th of its size, and which row the k-th of its shard, is counted in buckets and never in one task.

A group that holds much of the table is one key of the join of rows with their group's shard; both sides are plain tables
there, so Spark's adaptive execution splits its rows over tasks. The histogram is sqrt(2 B) entries at most: 14 million (0.2
GB) if every size up to that of B = 100 TB occurs, some thousands for texts as they are.

Defined cases: a null text is empty. Very long texts are groups like any other. Ties between groups of one size go by digest, between shards
by number. Rows that repeat an id are rows of their own. An empty table gives an empty result.
Columns other than id and text are not read. A single group that outweighs a shard's share still stays together.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
ROW_BYTES = 8
BUCKETS = 1024


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard gets, each in turn to the least-loaded (ties: lowest number).

    ``loads`` is updated. Few groups go through the heap; many are counted by the load up to which the heap would fill.
    """
    got = [0] * len(loads)
    if count > 2 * len(loads):
        low, high = min(loads), max(loads) + size * count
        while low < high:  # the largest level that needs at most count groups
            level = (low + high + 1) // 2
            if sum((level - x) // size + 1 for x in loads if x <= level) <= count:
                low = level
            else:
                high = level - 1
        got = [(low - x) // size + 1 if x <= low else 0 for x in loads]
        if sum(got) > count:  # even the lowest level needs more: ties there are dealt below
            got = [0] * len(loads)
        for j, n in enumerate(got):
            loads[j] += n * size
    heap = [(x, j) for j, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, j = heap[0]
        heapq.heapreplace(heap, (load + size, j))
        loads[j] += size
        got[j] += 1
    return got


def schedule(sizes: list[tuple[int, int]], shards: int) -> pa.Table:
    """(size, shards, upto): the k-th group of a size goes to the first of ``shards`` whose ``upto`` is over k."""
    loads = [0] * shards
    out: dict[str, list] = {"gsize": [], "at": [], "upto": []}
    for size, count in sorted(sizes, reverse=True):
        took, at, upto = 0, [], []
        for j, n in enumerate(deal(loads, size, count)):
            if n:
                took += n
                at.append(j)
                upto.append(took)
        out["gsize"].append(size)
        out["at"].append(at)
        out["upto"].append(upto)
    types = {"gsize": pa.int64(), "at": pa.list_(pa.int32()), "upto": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})


def numbered(rows: DataFrame, group: str, bucket: DataFrame | str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number (from 0) within ``group``, counted by bucket: first buckets, then rows of a bucket."""
    counts = rows.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, bucket, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    return rows.join(starts, [group, bucket]).withColumn(name, F.col("__start") + F.row_number().over(inside) - 1).drop("__start")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: no law of growth)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = written(
        rows.groupBy("digest").agg(F.sum("size").alias("gsize")).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")),
        "shard-groups",
    )
    sizes = groups.groupBy("gsize").agg(F.count(F.lit(1)).alias("n")).toPandas()
    table = schedule(list(zip(sizes["gsize"].tolist(), sizes["n"].tolist(), strict=True)), shards)
    dealt = spark.createDataFrame(table) if len(table) else spark.createDataFrame([], "gsize long, at array<int>, upto array<long>")
    placed = written(
        numbered(groups, "gsize", "bucket", ["digest"], "k")
        .join(dealt, "gsize")
        .select("digest", F.element_at("at", F.size(F.filter("upto", lambda x: x <= F.col("k"))) + 1).alias("shard")),
        "shard-of-groups",
    )
    out = written(
        rows.join(placed, "digest").select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")),
        "shard-placed",
    )
    return numbered(out, "shard", "bucket", ["id", "text_crc32"], "slot").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
