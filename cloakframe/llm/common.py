"""Shared folder, written tables and key helpers of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's path below the cluster's shared folder.

    The shared folder is ``spark.checkpoint.dir``; only a session of one machine may go without, and gets a local one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        spark.sparkContext.setCheckpointDir(base)
    return posixpath.join(base, f"{tag}-{uuid.uuid4().hex}")


FILES, PART = 4, 128 << 20  # files of a written table for each core at least, bytes that one of them may be expected to hold


def few_files(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``df`` in no more partitions than its expected size (or that of ``like``) asks for and FILES for each core, so that
    many small partitions aren't many small files. Large tables keep all of theirs, so no task grows long.

    Where executors come and go by demand, the number of cores says nothing, and all partitions stay.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return df
    size = int(str((like or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(1 << 30, max(FILES * max(2, context.defaultParallelism), -(-size // PART))))


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    few_files(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in whatever store Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def row_key(id_col: Column, text: Column) -> Column:
    """A key of a document that is never null: its id and the digest of its text (null and empty differ)."""
    return F.concat_ws(
        "|",
        F.when(id_col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), id_col.cast("string"))),
        F.when(text.isNull(), F.lit("n")).otherwise(F.sha2(text, 256)),
    )


MAYBE, SIEVE = "__maybe", 1 << 23


def sieved(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` with MAYBE: whether their ``digest`` may be in ``digests``. True for all that are, and for few others as long
    as SIEVE bits tell them apart."""
    bit = F.pmod(F.xxhash64("digest"), F.lit(SIEVE))
    word, mask = F.shiftright(bit, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = digests.groupBy(word.alias("__word")).agg(F.bit_or(mask).alias("__bits"))  # SIEVE / 64 rows at most
    held = rows.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    return held.withColumn(MAYBE, F.coalesce(F.col("__bits").bitwiseAND(mask) != 0, F.lit(False))).select(*rows.columns, MAYBE)


def free_name(columns: list[str], base: str) -> str:
    """A column's name that is not among ``columns``, whatever its case."""
    held = {c.lower() for c in columns}
    return next(n for k in range(len(held) + 1) if (n := f"__{base}{k or ''}") not in held)


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each key (``row_key``) in ``keys``; all columns stay, whatever their names.

    Rows that repeat a key are dropped before they move, all but one of each task, so many of them never meet in one task.
    """
    name = free_name(docs.columns, "key")
    keyed = docs.withColumn(name, row_key(F.col(id_col), F.col(text_col))).dropDuplicates([name])
    return keyed.join(keys.select(F.col(keys.columns[0]).alias(name)), name, "left_semi").drop(name)


HELD: dict[str, dict] = {}  # of this worker process, which Spark may use again for another operator


def held_for(owner: str) -> dict:
    """What ``owner`` keeps in this worker between tasks. What other operators kept here is let go, back to the system."""
    others = [k for k in HELD if k != owner]
    for k in others:
        del HELD[k]
    if others:
        let_go()
    return HELD.setdefault(owner, {})


def let_go() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def vocabulary_file(name: str) -> str:
    """The path of a vocabulary on this machine: ``name`` itself, or that of a public tokenizer's file of that name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


def slices(batch, sizes, limit: int):
    """``batch`` in runs of rows of at most ``limit`` by ``sizes`` together; a larger row is a run of its own."""
    import numpy as np

    upto, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(batch):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def store(uri: str):
    """The file system of ``uri`` and the path in it, for files that executors write to the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def replace_file(uri: str, write) -> None:
    """``write(stream)`` into a file that takes its place at ``uri`` only when it is whole; a rerun task overwrites it."""
    files, path = store(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own, compression=None) as out:
        write(out)
    files.move(own, path)
