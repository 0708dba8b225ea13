"""The whole way there and back: scan, veto, resolve, mint, rewrite; and restore.

Tokenizing fails closed: a text with an error goes to ``rejects`` (without its text), never to the output. Restoring fails
open: an unknown placeholder stays. Known values and hosts in paths see the vault as of the beginning of a batch.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detectors, formats, hosts
from ..functions.patterns import DETECTORS
from ..operators import detect, json_body, resolve
from ..operators.rules import Compiled, Rules
from ..operators.vault import Vault

WIRE = "array<struct<real:string,token:string,entity_type:string,wire_value:string>>"


@dataclass
class Tokenized:
    """``rows``: the input with the rewritten text. ``rejects``: id and error. ``audit``: one row per replacement.

    ``close`` (or leaving a ``with`` block) gives back what is cached for them."""

    rows: DataFrame
    rejects: DataFrame
    audit: DataFrame
    cached: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        for df in self.cached:
            df.unpersist()

    def __enter__(self) -> Tokenized:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


STARTS = "array<struct<at:int,head:string,part:string>>"
HEADS = 1 << 20  # places of the filter by which stored values' heads are known: what is broadcast


def _eligible(values: pd.Series) -> pd.Series:
    return values.map(detectors.eligible)


def starts_with(held: bytes, longest: int):
    """Finds the places of texts at which a stored value can begin: the bits of ``held`` know heads by their checksum, with some more."""

    def known(head: str) -> int:
        at = zlib.crc32(head.encode()) % HEADS
        return held[at >> 3] >> (7 - (at & 7)) & 1

    def each(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = detectors.starts(t or "")
            out.append([{"at": k, "head": h, "part": t[k : k + longest + 1]} for k, h in found if known(h)])
        return pd.Series(out)

    return F.pandas_udf(each, STARTS)


def replaced(found: list, tokens: list | None):
    """(detection, its placeholders, the text in its place) of each. A value without a placeholder is an error: nothing is written."""
    of = {t["real"]: t["token"] for t in ([] if tokens is None else tokens)}
    for d in [] if found is None else found:
        own = [of[x["real"]] for x in d["lookups"]]
        yield d, own, formats.replacement(d["kind"], d["before"], d["after"], own)


def _rewrite(texts: pd.Series, dets: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([t if d is None or not len(d) else formats.splice(t, [(x["start"], x["end"], new) for x, _, new in replaced(d, k)]) for t, d, k in zip(texts, dets, tokens, strict=True)])


def _wire(dets: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([
        [{"real": x["real"], "token": t, "entity_type": x["type"], "wire_value": new} for d, own, new in replaced(found, held) for x, t in zip(d["lookups"], own, strict=True)]
        for found, held in zip(dets, tokens, strict=True)
    ])


def _restore(texts: pd.Series, tokens: pd.Series, json: pd.Series) -> pd.Series:
    out = []
    for t, held, whole in zip(texts, tokens, json, strict=True):
        if t is not None and held is not None:
            of = {x["token"]: x["real"] for x in held}
            t = json_body.restore_value(t, lambda x, of=of: formats.restore(x, of)) if whole else formats.restore(t, of)
        out.append(t)
    return pd.Series(out)


def _candidates(texts: pd.Series) -> pd.Series:
    return pd.Series([formats.candidates(t) if t else [] for t in texts])


def _candidates_of(texts: pd.Series, json: pd.Series) -> pd.Series:
    """Placeholders of texts, or of the strings of JSON values."""
    return pd.Series([sorted({c for x in ([n.text for n in json_body.value_texts(t)] if whole else [t]) for c in formats.candidates(x)}) if t else [] for t, whole in zip(texts, json, strict=True)])


def key_of(text_col: str) -> Column:
    """The digest of a text. Nulls get keys of their own, which meet nothing, so they don't meet in one task either."""
    return F.coalesce(F.sha2(F.col(text_col), 256), F.concat(F.lit("null-"), F.monotonically_increasing_id().cast("string")))


class Redactor:
    """Tokenizes and restores text columns of DataFrames against one vault."""

    def __init__(self, spark: SparkSession, vault: Vault, rules: Rules | Compiled | None = None):
        self.spark, self.vault = spark, vault
        self.rules = rules if isinstance(rules, Compiled) else (rules or Rules()).compiled()

    def known_values(self) -> DataFrame:
        """(real, entity_type) of the stored values that are searched for without their label."""
        values = self.vault.label_only().select("real", "entity_type")
        return values.where(F.pandas_udf(_eligible, "boolean")("real"))

    def _known(self, texts: DataFrame, values: DataFrame) -> DataFrame | None:
        """(h, more): detections of stored values, met by the characters they begin with at places where one could stand.

        What moves is a place and as much text as the longest value, and only for places whose head a value may have.
        """
        head = F.substring("real", 1, detectors.KNOWN_LENGTH)
        places = values.select(F.pmod(F.crc32(head.cast("binary")), F.lit(HEADS)).cast("int").alias("p"), F.length("real").alias("n"))
        filled = places.groupBy("p").agg(F.max("n").alias("n")).toArrow()  # HEADS rows at most, however many values there are
        if not len(filled):
            return None
        held = np.zeros(HEADS, bool)
        held[filled.column("p").to_numpy()] = True
        starts = texts.select("h", F.explode(starts_with(np.packbits(held).tobytes(), int(filled.column("n").to_numpy().max()))("text")).alias("s")).select("h", "s.*")
        met = starts.join(values.withColumn("head", head), "head")
        n = F.length("real")
        same = F.expr("startswith(part, real)")
        apart = ~(F.col("real").rlike("[\\p{L}\\p{N}]\\z") & F.expr("substring(part, length(real) + 1, 1)").rlike("[\\p{L}\\p{N}]"))
        det = F.struct(
            F.col("at").alias("start"), (F.col("at") + n).cast("int").alias("end"), F.lit(1000).alias("det_ord"), F.col("at").alias("seq"),
            F.array(F.struct("real", F.col("entity_type").alias("type"))).alias("lookups"), F.lit("whole").alias("kind"),
            F.lit("").alias("before"), F.lit("").alias("after"), F.lit(False).alias("preserve"),
        )
        return met.where(same & apart).groupBy("h").agg(F.collect_list(det).alias("more"))

    def _found(self, texts: DataFrame, rules: Compiled, only_block: bool, cached: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(h, place, dets, error) of distinct texts, after the vetoes and without overlap; and (token) of the small
        placeholders that stand in the texts as they came. What is cached holds findings only, never a text."""
        scanned = texts.withColumn("scan", detect.scan(F.col("text"), rules, only_block)).select("h", "place", "scan.*")
        fresh = not self.vault.state()[1]  # an empty vault knows nothing yet
        more = None if only_block or fresh else self._known(texts, self.known_values())
        if more is not None:
            scanned = scanned.join(more, "h", "left").withColumn("dets", F.when(F.col("more").isNull(), F.col("dets")).otherwise(F.concat("dets", "more"))).drop("more")
        told = (F.size("dets") > 0) | (F.size("standing") > 0) | F.col("error").isNotNull()
        scanned = scanned.where(told).persist()
        cached.append(scanned)
        dets = resolve.allow_veto(F.col("dets"), rules.allow)
        if fresh:
            joined, known = scanned, F.lit(None)
        else:
            marks = scanned.select("h", F.explode("marks").alias("m")).select("h", "m.*").join(self.vault.spans(), "token", "left_semi")
            real = marks.groupBy("h").agg(F.collect_list(F.struct("start", "end")).alias("held"))
            paths = scanned.select("h", F.explode(F.filter("dets", lambda d: d["preserve"])).alias("d")).select("h", F.explode("d.lookups.real").alias("real"))
            stored = paths.join(self.vault.entries().select("real"), "real", "left_semi").groupBy("h").agg(F.collect_set("real").alias("known"))
            joined, known = scanned.join(real, "h", "left").join(stored, "h", "left"), F.col("known")
            dets = resolve.placeholder_veto(dets, F.coalesce("held", F.array().cast("array<struct<start:int,end:int>>")))
        found = joined.withColumn("dets", resolve.keep_paths(resolve.resolve_overlaps(dets), known)).select("h", "place", "dets", "error")
        return found, scanned.select(F.explode("standing").alias("token")).distinct()

    def _pass(self, rows: DataFrame, text_col: str, place: str, rules: Compiled, only_block: bool, name: str | None, cached: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """``rows`` (with __h, __error) with their texts rewritten, or with an error; and (real, token, ...) of all replacements."""
        sound = rows.where(F.col(text_col).isNotNull() & F.col("__error").isNull())
        texts = sound.groupBy(F.col("__h").alias("h")).agg(F.first(text_col).alias("text"), F.min(place).alias("place"))
        found, standing = self._found(texts, rules, only_block, cached)
        found = found.persist()
        cached.append(found)
        wanted = found.select("h", F.col("place").alias("p"), F.explode("dets").alias("d")).select(F.struct("p", "h", "d.start", "d.det_ord", "d.seq").alias("place"), "h", F.explode("d.lookups").alias("x"))
        wanted = wanted.select("h", "place", F.col("x.real").alias("real"), F.col("x.type").alias("entity_type"))
        tokens = self.vault.get_or_create(wanted.select("real", "entity_type", "place"), name, standing)
        held = wanted.select("h", "real").distinct().join(tokens, "real").groupBy("h").agg(F.collect_list(F.struct("real", "token")).alias("__tokens"))
        done = found.join(held, "h", "left").select("h", F.col("dets").alias("__dets"), F.col("error").alias("__e"), "__tokens").persist()
        cached.append(done)
        joined = rows.join(done, F.col("__h") == F.col("h"), "left")
        new = F.when(F.size("__dets") > 0, F.pandas_udf(hosts.shipped(_rewrite), "string")(F.col(text_col), F.col("__dets"), F.col("__tokens"))).otherwise(F.col(text_col))
        out = joined.withColumn(text_col, new).withColumn("__error", F.coalesce("__error", "__e")).select(*rows.columns)
        wire = F.pandas_udf(hosts.shipped(_wire), WIRE)("__dets", "__tokens")
        return out, done.where("__e is null and size(__dets) > 0").select(F.explode(wire).alias("w")).select("w.*")

    def tokenize(self, df: DataFrame, id_col: str, text_col: str, name: str | None = None) -> Tokenized:
        """``name`` makes a batch repeatable: running it again mints nothing new."""
        rules, cached = self.rules, []
        sound = F.col(text_col).isNull() | F.expr(f"is_valid_utf8(`{text_col}`)")
        keyed = df.withColumn("__h", key_of(text_col)).withColumn("__error", F.when(~sound, F.lit("invalid UTF-8")))
        out, wire = self._pass(keyed, text_col, id_col, rules, False, name, cached)
        if rules.block:  # the output is scanned again for what operators block
            out, more = self._pass(out, text_col, id_col, rules, True, f"{name}-block" if name else None, cached)
            wire = wire.unionByName(more)
        rows = out.where("__error is null").select(*df.columns)
        rejects = out.where("__error is not null").select(id_col, F.col("__error").alias("error"))
        audit = wire.select(F.lit("replacement").alias("event"), F.lit("tokenize").alias("direction"), "*")
        return Tokenized(rows, rejects, audit, cached)

    def detokenize(self, df: DataFrame, text_col: str, json: Column | None = None) -> DataFrame:
        """``df`` with the values back in ``text_col``. Candidates are looked up by a join; the vault is never collected.

        ``json``: whether a row's text is a JSON value, of which only the strings are restored.
        """
        whole = F.coalesce(F.lit(False) if json is None else json, F.lit(False))
        keyed = df.withColumn("__json", whole).withColumn("__h", F.concat(F.col("__json").cast("string"), key_of(text_col)))
        held = F.col("__json") | detect.may_restore(F.col(text_col))  # JSON may spell a placeholder in other ways
        texts = keyed.where(F.col(text_col).isNotNull() & held).groupBy(F.col("__h").alias("h")).agg(F.first(text_col).alias("t"), F.first("__json").alias("j"))
        asked = texts.select("h", F.explode(F.pandas_udf(_candidates_of, "array<string>")("t", "j")).alias("token"))
        held = asked.join(self.vault.entries().select("token", "real"), "token").groupBy("h").agg(F.collect_list(F.struct("token", "real")).alias("__held"))
        joined = keyed.join(held, F.col("__h") == F.col("h"), "left")
        back = F.when(F.col("__held").isNull(), F.col(text_col)).otherwise(F.pandas_udf(hosts.shipped(_restore), "string")(F.col(text_col), F.col("__held"), F.col("__json")))
        return joined.withColumn(text_col, back).select(*df.columns)


def differences(before: DataFrame, after: DataFrame, id_col: str, text_col: str, around: int = 20) -> DataFrame:
    """(id, at, before, after) of the rows whose texts differ: where they first do, and some characters of each from there."""

    def first(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(os.path.commonprefix([x or "", y or ""])) for x, y in zip(a, b, strict=True)], dtype="int64")

    pairs = before.select(id_col, F.col(text_col).alias("a")).join(after.select(id_col, F.col(text_col).alias("b")), id_col, "full")
    found = pairs.where(~F.col("a").eqNullSafe(F.col("b"))).withColumn("at", F.pandas_udf(first, "long")("a", "b"))
    part = lambda c: F.substring(F.col(c), (F.col("at") + 1).cast("int"), F.lit(around))
    return found.select(id_col, "at", part("a").alias("before"), part("b").alias("after"))


SNAPSHOT = 200_000  # entries of a vault that SQL functions take along; beyond that the Redactor's joins are the way


def register_functions(spark: SparkSession, rules: Rules | None = None, vault: Vault | None = None) -> None:
    """SQL functions: ``detect(text)`` (array of detections), ``detections(text)`` (a table function, a row for each),
    ``placeholder_candidates(text)``; with a vault of at most SNAPSHOT entries ``tokenize(text)`` and ``detokenize(text)``.

    These two know the vault as of now. ``tokenize`` mints nothing: a text with a value that has no placeholder yet is an
    error, so nothing leaves unredacted. The Redactor mints, and works on vaults of any size.
    """
    compiled = (rules or Rules()).compiled()

    def found(text: str | None) -> list[detectors.Detection]:
        return detectors.detect(text or "", compiled.disabled, compiled.forced, compiled.block)

    def listed(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": d.start, "end": d.end, "category": d.order, "value": t[d.start : d.end]} for d in found(t)] for t in texts])

    class Detections:
        def eval(self, text: str | None):
            for d in found(text):
                yield d.start, d.end, DETECTORS[d.order].name if d.order < len(DETECTORS) else "custom", text[d.start : d.end]

    spark.udf.register("detect", F.pandas_udf(hosts.shipped(listed), "array<struct<start:int,end:int,category:int,value:string>>"))
    spark.udf.register("placeholder_candidates", F.pandas_udf(_candidates, "array<string>"))
    spark.udtf.register("detections", F.udtf(Detections, returnType="start int, end int, category string, value string"))
    if vault is None:
        return
    rows = vault.entries().select("real", "token").limit(SNAPSHOT + 1).collect()
    if len(rows) > SNAPSHOT:
        raise ValueError(f"the vault has over {SNAPSHOT} entries: use the Redactor")
    token_of, real_of = {r["real"]: r["token"] for r in rows}, {r["token"]: r["real"] for r in rows}
    allowed = re.compile(compiled.allow.replace(r"\z", r"\Z")) if compiled.allow else None

    def hidden(text: str | None) -> str | None:
        if text is None:
            return None
        marks = [(s, e) for s, e, t in formats.occurrences(text) if t in real_of]
        spans, at = [], 0
        for d in sorted(found(text), key=lambda d: (d.start, d.start - d.end, d.order)):
            vetoed = any(s < d.end and d.start < e for s, e in marks) or (allowed and any(allowed.match(r) for r, _ in d.lookups))
            kept = d.keep and not all(r in token_of for r, _ in d.lookups)
            if d.start < at or vetoed or kept:
                continue
            if any(r not in token_of for r, _ in d.lookups):
                raise ValueError("a value without a placeholder: let the Redactor mint one first")
            spans.append((d.start, d.end, formats.replacement(d.kind, d.before, d.after, [token_of[r] for r, _ in d.lookups])))
            at = d.end
        return formats.splice(text, spans)

    each = lambda f: F.pandas_udf(hosts.shipped(lambda texts: pd.Series([f(t) for t in texts], dtype=object)), "string")
    spark.udf.register("tokenize", each(hidden))
    spark.udf.register("detokenize", each(lambda t: t if t is None else formats.restore(t, real_of)))
