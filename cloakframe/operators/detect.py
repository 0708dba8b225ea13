"""Detection: all detectors in one Arrow UDF, and single patterns as native Columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import detectors, formats, hosts
from ..functions.entities import EITHER_CASE, SHAPES, marker, shape_pattern
from ..functions.patterns import DETECTORS, NEEDS, Detector, java_pattern
from .rules import Compiled

DETECTION = (
    "start int, end int, det_ord int, seq int, lookups array<struct<real:string,type:string>>, "
    "kind string, before string, after string, preserve boolean"
)
SCAN = f"struct<dets:array<struct<{', '.join(x.replace(' ', ':', 1) for x in DETECTION.split(', '))}>>,marks:array<struct<start:int,end:int,token:string>>,standing:array<string>,error:string>"
REGISTERED: dict[str, Callable] = {}


def register_detector(name: str, find: Callable) -> None:
    """Adds a detector: ``find(text)`` yields (start, end, ((real, entity), ...)). Its errors reject the row."""
    REGISTERED[name] = find


STANDING, ALWAYS = 60, 61  # bits of a mask beside those of the catalogue's detectors


def _any(tests: list[Column]) -> Column:
    return functools.reduce(operator.or_, tests) if tests else F.lit(True)


def mask(text: Column, rules: Compiled, only_block: bool = False) -> Column:
    """Which detectors can find something in a text, natively: a bit for each, by its literals and what it needs."""
    bits = [F.lit(0).cast("long")]
    if only_block or rules.block or REGISTERED:
        bits.append(F.lit(1 << ALWAYS))
    low = F.lower(text)
    for k, d in enumerate(DETECTORS):
        if not only_block and not rules.off(d.name):
            held = _any([F.contains(low, F.lit(x)) for x in d.literals])
            if d.name in NEEDS:
                held = held & text.rlike(java_pattern(NEEDS[d.name]))
            bits.append(F.when(held, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    bits.append(F.when(_any([F.contains(text, F.lit(x)) for x in formats.SMALL_MARKS]), F.lit(1 << STANDING)).otherwise(F.lit(0)).cast("long"))
    return F.coalesce(functools.reduce(lambda a, b: a.bitwiseOR(b), bits), F.lit(0).cast("long"))


def scan(text: Column, rules: Compiled, only_block: bool = False) -> Column:
    """struct(dets, marks, standing, error) of each text: detections, placeholders that stand in it, those of networks
    and small spaces that stand in it by whatever chance, and why it is rejected. Texts that no detector needs don't go to Python."""
    extra = tuple(REGISTERED.values())

    def each(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        rows = []
        for t, m in zip(texts, masks, strict=True):
            if not m:
                rows.append(([], [], [], None))
                continue
            try:
                if only_block:
                    found = [detectors.Detection(x[0], x[1], 0, *x[2:]) for x in detectors.blocked(t or "", rules.block)]
                else:
                    found = detectors.detect(t or "", rules.disabled, rules.forced, rules.block, extra, m)
                dets = [
                    {"start": d.start, "end": d.end, "det_ord": d.order, "seq": k, "lookups": [{"real": r, "type": e} for r, e in d.lookups], "kind": d.kind, "before": d.before, "after": d.after, "preserve": d.keep}
                    for k, d in enumerate(found)
                ]
                marks = [{"start": s, "end": e, "token": x} for s, e, x in formats.occurrences(t or "")] if found else []
                rows.append((dets, marks, formats.standing(t or "") if m >> STANDING & 1 else [], None))
            except Exception as e:  # the one place that turns a detector's error into a rejected row
                rows.append(([], [], [], f"{type(e).__name__}"))
        return pd.DataFrame(rows, columns=["dets", "marks", "standing", "error"])

    held = mask(text, rules, only_block)
    return F.pandas_udf(hosts.shipped(each), SCAN)(F.when(held != 0, text), held)


def may_restore(text: Column) -> Column:
    """Whether a text can hold a placeholder, natively: by the texts that placeholders of each entity hold."""
    held = [F.contains(text, F.lit(marker(e))) for e in SHAPES if e not in ("domain", *EITHER_CASE)]
    held += [F.contains(F.lower(text), F.lit(marker(e).lower())) for e in EITHER_CASE]
    held += [F.contains(text, F.lit(x)) for x in formats.NETWORK_MARKS]
    return _any([text.rlike(shape_pattern("domain")), *held])


def matches(text: Column, detector: Detector) -> Column:
    """The values that a pattern detector replaces, natively: the array of its matches without placeholders."""
    hit = _any([F.contains(F.lower(text), F.lit(x)) for x in detector.literals])
    found = F.regexp_extract_all(text, F.lit(java_pattern(detector.pattern)), F.lit(int(detector.capture)))
    if detector.mark:
        found = F.filter(found, lambda x: ~F.contains(x, F.lit(detector.mark)))
    return F.when(hit, found).otherwise(F.array().cast("array<string>"))


def spans(text: Column, pattern: str) -> Column:
    """(start, end, value) of a whole-match pattern's matches, natively: the gaps between them give the offsets."""
    java = java_pattern(pattern)
    found = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    gaps = F.split(text, java, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.slice(F.transform(pairs, lambda p: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), p["value"].alias("value"))), 1, 0).alias("out"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])
