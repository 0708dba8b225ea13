"""Which detections stand: vetoes by allow list and by placeholders, then the leftmost-longest ones without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_overlaps(dets: Column) -> Column:
    """Sorted by start, longest first, then catalogue order; one is kept if it starts where the last kept one ended or later."""

    def order(a, b):
        longer = (b["end"] - b["start"]) - (a["end"] - a["start"])
        by = F.when(a["start"] != b["start"], a["start"] - b["start"]).when(longer != 0, longer).when(a["det_ord"] != b["det_ord"], a["det_ord"] - b["det_ord"])
        return by.otherwise(a["seq"] - b["seq"]).cast("int")

    none = F.struct(F.lit(0).alias("upto"), F.slice(dets, 1, 0).alias("kept"))

    def step(acc, d):
        return F.when(d["start"] >= acc["upto"], F.struct(d["end"].alias("upto"), F.concat(acc["kept"], F.array(d)).alias("kept"))).otherwise(acc)

    return F.aggregate(F.array_sort(dets, order), none, step, lambda acc: acc["kept"])


def allow_pattern(values: list[str], hosts: list[str]) -> str | None:
    """One pattern for all allow entries: hosts with their subdomains, and patterns that must match a whole value."""
    parts = [rf"(?:[\s\S]*\.)?(?:{'|'.join(sorted(h.replace('.', '[.]') for h in hosts))})"] if hosts else []
    return rf"(?i)\A(?:{'|'.join([*parts, *values])})\z" if parts or values else None


def allow_veto(dets: Column, pattern: str | None) -> Column:
    """Drops a detection if any of its values is allowed."""
    return F.filter(dets, lambda d: ~F.exists(d["lookups"], lambda x: x["real"].rlike(pattern))) if pattern else dets


def placeholder_veto(dets: Column, marks: Column) -> Column:
    """Drops detections that overlap a placeholder (interval anti-join within the row)."""
    return F.filter(dets, lambda d: ~F.exists(marks, lambda m: (d["start"] < m["end"]) & (m["start"] < d["end"])))


def overlap_antijoin(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """Rows of ``left`` (keys, start, end) that overlap no interval of ``right`` with the same keys.

    Intervals are dealt into cells of ``width``, so the join is an equi-join on (keys, cell) with a range test.
    """
    cell = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width)))
    a = left.withColumn("__row", F.struct(*left.columns)).withColumn("__cell", cell())
    b = right.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), cell().alias("__cell"))
    hit = a.join(b, [*keys, "__cell"]).where((F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end"))).select(*left.columns).distinct()
    return left.join(hit, left.columns, "left_anti")


def keep_paths(dets: Column, known: Column) -> Column:
    """Hosts in a path stay only if ``known`` has their value, or another detection of the same text established it."""
    sure = F.flatten(F.transform(F.filter(dets, lambda d: ~d["preserve"]), lambda d: F.transform(d["lookups"], lambda x: x["real"])))
    both = F.array_union(sure, F.coalesce(known, F.array().cast("array<string>")))
    return F.filter(dets, lambda d: ~d["preserve"] | F.forall(d["lookups"], lambda x: F.array_contains(both, x["real"])))
