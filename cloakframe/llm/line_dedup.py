"""Line dedup by winnowing over line hashes; DataFrame functions only.

A run of at least RUN lines that stands at an earlier place too is deleted. Places are ordered by (id, line number).
Every window of RUN consecutive lines selects the smallest line hash in it (the rightmost of equal ones). The selected
positions, each once, are the document's fingerprints, about 2 in RUN + 1 lines: two equal runs of RUN lines always share
one. Only they are written, each with the keys of the windows that selected it. Positions whose fingerprint stands elsewhere
too are joined with the first place of each window around them; from there the match is extended to the left and to the
right over all windows that agree, so runs become maximal, and all runs that have an earlier place are deleted.

A window is known by two independent 64-bit hashes of each of its lines, so lines are told apart by 128 bits and texts are
never compared: among 10**12 different lines one pair is confused with a chance below 10**-14.

Defined cases: a null text has no lines and stays null; an empty text is one empty line. Shorter repeats than RUN lines
stay, and so do texts shorter than that. Ties: the first place stays; rows that repeat an id stand at the same place, so
neither of two texts under one id is ever later than the other at the same line. A null id orders first. Very long texts
are one row of arrays of 16 bytes a line. An empty table gives an empty result. Other columns are not read.

``op1_line_dedup`` deletes runs of RUN lines, as its SQL says. ``op1_line_dedup_single`` is the same with runs of one line: every
later line that holds more than white space goes, in texts of any number of lines; blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

RUN = 3
FULL = r"[^ \t\r\f\x0B]"
SALTS = 16  # tasks that share the rows of one fingerprint or window


def fingerprints(docs: DataFrame, id_col: str, text_col: str, run: int, blank: bool = True) -> DataFrame:
    """One row per selected position: document (id, text hash), fingerprint, first window that selected it, and the keys of
    that one and those that follow; a key is null for a window of blank lines only, unless ``blank``."""

    def line(x):
        # The second hash is of another text, so it is independent of the first.
        hashes = [F.xxhash64(x).alias("a"), F.xxhash64(F.concat(F.lit("#"), x)).alias("b")]
        return F.struct(*hashes) if blank else F.struct(*hashes, x.rlike(FULL).alias("full"))

    hashed = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("th"),
        F.transform(F.split(text_col, "\n"), line).alias("h"),
    ).where(F.size("h") >= run)

    def selected(s):
        least = F.array_min(F.transform(F.slice("h", s + 1, run), lambda x, j: F.struct(x["a"].alias("a"), (-(s + j)).alias("at"))))
        return F.struct(least["a"].alias("print"), (-least["at"]).alias("at"), s.alias("start"))

    starts = F.sequence(F.lit(0), F.size("h") - run)
    # Windows that select a position follow each other, so each position is named by the first of them.
    every = hashed.withColumn("w", F.transform(starts, selected))
    firsts = every.withColumn("p", F.filter("w", lambda x, k: (k == 0) | (F.get("w", k - 1)["at"] != x["at"])))

    def key(s):
        part = F.slice("h", s + 1, run)
        found = F.struct(F.xxhash64(F.transform(part, lambda x: x["a"])).alias("k1"), F.xxhash64(F.transform(part, lambda x: x["b"])).alias("k2"))
        return found if blank else F.when(F.exists(part, lambda x: x["full"]), found)

    def position(x, k):
        last = F.coalesce(F.get("p", k + 1)["start"], F.size("w")) - 1
        return F.struct(x["print"].alias("print"), x["start"].cast("int").alias("start"), F.transform(F.sequence(x["start"], last), key).alias("keys"))

    out = firsts.select("id", "th", F.inline(F.transform("p", position)))
    return out if blank else out.where(F.exists("keys", lambda k: k.isNotNull()))


def salted(df: DataFrame) -> DataFrame:
    """``df`` dealt to SALTS tasks a key, by document."""
    return df.withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int"))


def all_salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, blank: bool = True) -> DataFrame:
    """(id, th, runs): the maximal runs (begin, end; lines from 0) of a document that repeat an earlier run."""
    every = written(fingerprints(docs, id_col, text_col, run, blank), "line-prints")
    place = F.struct("id", "th", "start")
    shared = every.groupBy("print").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("print")
    joined = salted(every).join(all_salts(shared), ["print", "salt"], "left_semi")
    around = joined.select("id", "th", F.posexplode("keys").alias("k", "key"), "start").where("key is not null")
    matched = around.select("id", "th", (F.col("start") + F.col("k")).alias("start"), "key.*")
    at = F.struct("id", "start", "th")
    first = matched.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").drop("last")
    later = salted(matched).join(all_salts(first), ["k1", "k2", "salt"]).where(F.struct("id", "start") > F.struct("first.id", "first.start"))
    starts = later.select("id", "th", "start").distinct()
    # Extension: a window that begins inside of, or just behind, a matched one carries its run on.
    inside = Window.partitionBy("id", "th").orderBy("start")
    islands = starts.withColumn("new", F.coalesce((F.col("start") > F.lag("start").over(inside) + run).cast("int"), F.lit(1))).withColumn(
        "island", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = islands.groupBy("id", "th", "island").agg(F.min("start").alias("begin"), (F.max("start") + run).alias("end"))
    return merged.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, blank: bool = True) -> DataFrame:
    """One row per document: id, text without its later repeated runs, n_lines, removed_lines, runs."""
    # Written, so that adaptive execution can split the rows of a document that stands many times; never broadcast, as it grows.
    runs = written(repeated_runs(docs, id_col, text_col, run, blank).select(F.col("id").alias("rid"), F.col("th").alias("rth"), "runs"), "line-runs")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    joined = base.join(runs.hint("merge"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    lines = F.split("text", "\n")
    # What stays lies between one run's end and the next one's beginning.
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))
    ends = F.concat(F.transform("runs", lambda r: r["begin"]), F.array(F.size(lines)))
    stays = F.flatten(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.slice(lines, x["b"] + 1, x["e"] - x["b"])))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["begin"]), F.lit(0)).cast("long").alias("removed_lines"),
        "runs",
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (
  SELECT doc_id, i, line, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3 FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, i, (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY line, l2, l3) AS later FROM w WHERE l3 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM f WHERE later),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS removed_lines,
         string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines, sha256(coalesce(kept, '')) AS text_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""


def op1_line_dedup_single(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), run=1, blank=False)
    return out.select("doc_id", "n_lines", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SINGLE_ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^ \t\r\f\x0B]') AND (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY line) AS later FROM l),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (later) AS removed_lines,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT later) AS kept
  FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines, sha256(coalesce(kept, '')) AS text_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
