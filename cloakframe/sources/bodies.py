"""Bodies and event frames as sources, rewritten bodies and audit events as sinks."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BODY_BYTES = 64 << 20
AUDIT_LEVELS = ("off", "new_value", "replacement", "full_body", "full_sse_frame")
# Media types of JSON lines.
LINE_TYPES = ("application/jsonl", "application/x-ndjson", "application/ndjson", "application/x-jsonl")


def read_bodies(spark: SparkSession, path: str, limit: int = BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path, body) of whole files, gzip ones inflated up to ``limit`` bytes; and (path, error) of those that are refused."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    read = files.withColumn("__b", inflate(F.col("content"), limit)).select("path", "__b.*")
    return read.where("error is null").select("path", "body"), read.where("error is not null").select("path", "error")


def inflate(content: Column, limit: int = BODY_BYTES) -> Column:
    """struct(body, error): text of plain or gzip bytes, refused beyond ``limit`` bytes or if it isn't UTF-8."""

    @F.pandas_udf("struct<body:string,error:string>")
    def each(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contents:
            try:
                if c[:2] == b"\x1f\x8b":
                    machine = zlib.decompressobj(31)
                    data = machine.decompress(c, limit + 1)
                    if not machine.eof and len(data) <= limit:
                        raise ValueError("the gzip stream ends early")
                else:
                    data = c
                if len(data) > limit:
                    raise ValueError("over the size limit")
                rows.append((bytes(data).decode(), None))
            except (ValueError, zlib.error) as e:
                rows.append((None, "invalid UTF-8" if isinstance(e, UnicodeDecodeError) else str(e)))
        return pd.DataFrame(rows, columns=["body", "error"])

    return each(content)


def is_json(body: Column, media_type: Column) -> Column:
    """Whether a body is read as JSON: by its media type, or because it begins like it after a mark and blanks."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(media_type, F.lit("")), ";", 1)))
    begins = F.substring(F.regexp_replace(body, "\\A\\x{FEFF}?[ \\t\\r\\n]*", ""), 1, 1)
    return (kind == "application/json") | kind.endswith("+json") | kind.isin(*LINE_TYPES) | begins.isin("{", "[")


def stream_bodies(spark: SparkSession, path: str, limit: int = BODY_BYTES, at_once: int = 16) -> DataFrame:
    """(path, body, error) of files as they come, ``at_once`` in a batch: those that wait stay where they lie."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", at_once).load(path)
    return files.withColumn("__b", inflate(F.col("content"), limit)).select("path", "__b.*")


def write_bodies(bodies: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Bodies that go on: gzip JSON lines of all columns, in files of bounded size."""
    bodies.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path, compression="gzip")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 0, line): JSON lines, blank ones kept. Lines are counted by split, so they need not move."""
    rows = spark.read.text(path).select(
        F.input_file_name().alias("path"), F.input_file_block_start().alias("__block"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line")
    )
    ahead = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))  # a row a split
    starts = splits.select("path", "__block", "__first", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), ["path", "__block"]).select("path", (F.col("__start") + F.col("__id") - F.col("__first")).alias("line_no"), "line")


def restore_lines(redactor, lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines with the values back in their JSON values' strings; blank lines and what isn't JSON stay as they are."""
    return redactor.detokenize(lines, line_col, F.lit(True))


def parse_frames(text: Column) -> Column:
    """array(struct(event, data)) of an event stream's text: data lines are joined, a last frame needs no blank line."""
    lines = lambda frame: F.split(frame, "\\r?\\n")
    value = lambda frame, name: F.transform(F.filter(lines(frame), lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"\\A{name}: ?", ""))
    frames = F.filter(F.split(text, "(?:\\r?\\n){2,}"), lambda f: F.length(F.trim(f)) > 0)
    return F.transform(frames, lambda f: F.struct(F.element_at(F.concat(value(f, "event"), F.array(F.lit(""))), 1).alias("event"), F.array_join(value(f, "data"), "\n").alias("data")))


def format_frame(event: Column, data: Column) -> Column:
    """A frame's text: one data line for each line of its data."""
    head = F.when(F.length(event) > 0, F.concat(F.lit("event: "), event, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, F.array_join(F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n\n"))


def write_audit(events: DataFrame, path: str, level: str = "replacement", rows_per_file: int = 100_000) -> None:
    """Appends audit events (column event) up to ``level`` as gzip JSON lines in files of bounded size."""
    kept = AUDIT_LEVELS[1 : AUDIT_LEVELS.index(level) + 1]
    stamped = events.where(F.col("event").isin(*kept)).withColumn("ts", F.current_timestamp())
    stamped.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path, compression="gzip")
