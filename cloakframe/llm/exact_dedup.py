"""Exact dedup as a stateful stream.

Rows pass through Structured Streaming once. The state store (RocksDB, on disk, checkpointed to the shared folder) holds
for each digest the identifier of the row that stays, its locator in the source and the number of rows; without a watermark
it never expires. A locator is the file and the row in it where the content lies (for sources that aren't files, a number).
After the stream, the full bytes of each hit, a digest of several rows, are compared in the source; where two texts share
a digest, their rows are grouped again by the texts themselves. Rows that are alone with their digest are not read again:
a filter of a million bytes (``sieved``), which is all that is broadcast, keeps nearly all of them out; what it lets through
is compared, so it never decides.

Defined cases: a null text counts as empty. Of equal texts the row with the largest id stays; null ids come last, and of
rows that repeat an id and a text exactly one stays (that with the largest locator). Very long texts are compared whole. An
empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAYBE, exists, few_files, row_key, shared_dir, sieved, written

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no room set aside in each
    # All stores of an executor share this much native memory.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Half as many files: the checkpoint serves one run, and the file systems check their blocks themselves.
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and those of STORE, which no other query sees."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in STORE.items():
        own.conf.set(k, v)
    return own


def keyed_state(stream: DataFrame) -> DataFrame:
    """Keyed state of a stream of (digest, id, locator): who stays, where its content is, how many rows there are.

    The same expression serves any source; in update mode a changed group is emitted again.
    """
    return stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))


def run_stream(staged: DataFrame, path: str, batches: int) -> DataFrame:
    """The state of the groups after all of the staged files went through the stream."""
    spark = staged.sparkSession
    work = shared_dir(spark, "dedup-stream")
    files = max(1, math.ceil(len(staged.inputFiles()) / batches))
    changed = keyed_state(own_session(spark).readStream.schema(staged.schema).option("maxFilesPerTrigger", files).parquet(path))
    # A batch that runs again after a failure overwrites its own folder, so a change is never counted twice.
    query = (
        changed.writeStream.outputMode("update")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, n: few_files(df, staged).write.mode("overwrite").parquet(f"{work}/changes/batch={n}"))
        .start()
    )
    query.awaitTermination()
    if not exists(spark, f"{work}/changes"):  # an empty source makes no batch
        return spark.createDataFrame([], changed.schema)
    changes = spark.read.schema(changed.schema).parquet(f"{work}/changes")
    return changes.groupBy("digest").agg(F.max_by("keep", "n").alias("keep"), F.max("n").alias("n"))


def located(docs: DataFrame) -> Column:
    """Where a row's content lies: file and row of a Parquet source, else a number that holds for one reading."""
    hidden = docs._jdf.queryExecution().analyzed().metadataOutput()
    known = [hidden.apply(k) for k in range(hidden.length())]
    if any(x.name() == "_metadata" and "row_index" in x.dataType().fieldNames() for x in known) and "_metadata" not in docs.columns:
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
    batches: int = 2,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, and ``row_key`` of the source row.

    ``digest`` may collide, SHA-256 itself too: groups that only share a digest are told apart by their bytes.
    ``batches``: the number of micro-batches that the staged rows are dealt into.
    """
    spark = docs.sparkSession
    raw = F.col(text_col)
    text = normalise(F.coalesce(raw, F.lit("")))
    whole = docs.select(F.col(id_col).alias("id"), text.alias("text"), row_key(F.col(id_col), raw).alias("row_key"), located(docs).alias("locator"))
    whole = whole.withColumn("digest", digest(F.col("text")))
    path = shared_dir(spark, "dedup-staged")
    rows = whole.select("id", "digest", F.sha2("text", 256).alias("text_sha256"), "row_key", "locator")
    few_files(rows).write.parquet(path)
    staged = spark.read.schema(rows.schema).parquet(path)
    state = written(run_stream(staged, path, batches), "dedup-state")

    # Full bytes of the hits: all texts of a digest are equal when the smallest and the largest are. Partial aggregation
    # leaves one row of a group for each task, so a group of copies is never gathered.
    hits = state.where("n > 1").select("digest")
    ends = sieved(whole.select("digest", "text"), hits).where(F.col(MAYBE)).groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    clash = written(ends.where("lo <> hi").select("digest"), "dedup-clash")

    out = staged.join(state.select("digest", "keep", "n"), "digest")
    plain = out.select(
        "id",
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
        "text_sha256",
        "row_key",
        "digest",
    )
    if not clash.isEmpty():
        # Equal digests of different texts: the texts themselves take their place. No digest decides here.
        again = whole.join(clash, "digest", "left_semi").withColumn("text_sha256", F.sha2("text", 256))
        again = written(again, "dedup-again")
        groups = again.groupBy("text").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
        told = again.join(groups, "text").select(
            "id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("locator") == F.col("keep.locator")).alias("kept"), "text_sha256", "row_key", "digest",
        )
        plain = plain.join(clash, "digest", "left_anti").select(*told.columns).unionByName(told)
    return plain.drop("digest").withColumnRenamed("id", id_col)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).drop("row_key")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
