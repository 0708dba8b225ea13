"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: 64 bits, a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles.
Two fingerprints within 4 bits agree in two of six blocks of their bits at least, so each pair of linked fingerprints
meets in a bucket of one of the 15 choices of two blocks. Within buckets, fingerprints are sorted by Gray rank, which puts
those that share many bits side by side; runs of eight form nodes, runs of eight nodes form upper nodes. A node holds the
bits that all below it share (mask) and their values (pattern). The search descends pairs of nodes and adds up the
differences on the bits that the next level newly fixes: a pair of groups over 4 is dropped whole, as is a pair whose
members are known to be connected. Each bucket returns a spanning star of its links, never its pairs.

Buckets over CAP are dealt into parts, of which any two meet in one task, so none is cut short. Distinct fingerprints
only are indexed; equal ones are linked by their value. Components come from large-star and small-star rounds over the
stars, each round a table in the shared folder.

Joins of rows with their fingerprint's component, and of links with a node's smallest neighbour, are between plain tables,
so Spark's adaptive execution splits a fingerprint that many rows share, or a node with many links, over tasks.

Defined cases: null and blank texts have fingerprint 0, linked like any other; texts of fewer words than a shingle are one
shingle. Rows that repeat an id are linked if their fingerprints are. Null ids take part; a component's id is its
smallest id that isn't null. Very long texts are hashed whole, 65,536 shingles at a time. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_for, row_key, written

WORDS, RADIUS, SEED = 4, 4, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
CAP = 200_000
FAN = 8
PAIRS = 1 << 20
ROWS = 1 << 18
ROUNDS = 64


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text. bytes.lower and bytes.split know A-Z and the six ASCII white spaces only."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    begins = [0, *ends]
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(line, SEED)]
    else:
        hashes = [digest(line[b : e - 1], SEED) for b, e in zip(begins, ends[words - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, row_key, fp as a signed long) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("simhash")
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row_key"), pa.array(fps.view(np.int64))], names=["id", "row_key", "fp"])

    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, row_key string, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; ``label`` holds the smallest member of each one's class, before and after."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        label[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := label[label], label):
            label[:] = up


class GrayIndex:
    """The index of many buckets at once: fingerprints sorted by (bucket, Gray rank), and nodes level by level."""

    def __init__(self, bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS):
        order = np.lexsort((gray_rank(fps), bucket))
        bucket, self.fps, self.radius = bucket[order], fps[order], radius
        self.codes, self.member = np.unique(self.fps, return_inverse=True)
        self.label = np.arange(len(self.codes))
        self.every, self.some, self.first = [self.fps], [self.fps], []  # by level: AND and OR of what is below, first child
        while len(bucket) and (len(bucket) > 1 and (bucket[1:] == bucket[:-1]).any()):
            new = np.r_[True, bucket[1:] != bucket[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
            at = np.flatnonzero((np.arange(len(bucket)) - start) % FAN == 0)
            self.every.append(np.bitwise_and.reduceat(self.every[-1], at))
            self.some.append(np.bitwise_or.reduceat(self.some[-1], at))
            self.first.append(np.r_[at, len(bucket)])
            bucket = bucket[at]
        self.mask = [~(a ^ b) for a, b in zip(self.every, self.some, strict=True)]

    def spans(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By level, the smallest and largest class below each node: equal if all below are connected."""
        low = high = self.label[self.member]
        lows, highs = [low], [high]
        for first in self.first:
            lows.append(np.minimum.reduceat(lows[-1], first[:-1]))
            highs.append(np.maximum.reduceat(highs[-1], first[:-1]))
        return lows, highs

    def connect(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, class) of those that are linked to a smaller one, over all buckets."""
        if self.first:
            near = np.flatnonzero(np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= self.radius)
            merge(self.label, self.member[near], self.member[near + 1])
            self.descend()
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.codes[moved], self.codes[self.label[moved]]

    def descend(self) -> None:
        lows, highs = self.spans()
        tested, top = 0, len(self.first)
        roots = np.arange(len(self.every[top]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.uint8), self.mask[top])]
        while stack:
            level, a, b, d, m = stack.pop()
            if level == 0:
                merge(self.label, self.member[a], self.member[b])
                if tested > PAIRS:
                    (lows, highs), tested = self.spans(), 0
                continue
            first = self.first[level - 1]
            wide = (first[a + 1] - first[a]) * (first[b + 1] - first[b])
            upto = np.cumsum(wide)
            if upto[-1] > PAIRS and len(a) > 1:  # bounded memory: halves later
                k = max(1, min(len(a) - 1, int(np.searchsorted(upto, PAIRS))))
                stack.append((level, a[k:], b[k:], d[k:], m[k:]))
                a, b, d, m, wide, upto = a[:k], b[:k], d[:k], m[:k], wide[:k], upto[:k]
            pair = np.repeat(np.arange(len(a)), wide)
            k = np.arange(len(pair)) - (upto - wide)[pair]
            across = (first[b + 1] - first[b])[pair]
            i, j = first[a][pair] + k // across, first[b][pair] + k % across
            level -= 1
            keep = (i <= j) if level else (i < j)
            keep &= ~((lows[level][i] == highs[level][i]) & (lows[level][j] == highs[level][j]) & (lows[level][i] == lows[level][j]))
            i, j, pair = i[keep], j[keep], pair[keep]
            both = self.mask[level][i] & self.mask[level][j]
            more = np.bitwise_count((self.every[level][i] ^ self.every[level][j]) & both & ~m[pair])
            d = d[pair] + more
            tested += len(d)
            keep = d <= self.radius
            if keep.any():
                stack.append((level, i[keep], j[keep], d[keep], both[keep]))


def links_in(batches: Iterator[pa.RecordBatch], radius: int = RADIUS, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Stars of linked fingerprints (u to the smaller v) from rows (choice, bits, part, other, fp) sorted by bucket."""

    def star(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).to_numpy() for c in ("choice", "bits", "part", "other")]
        bucket = np.cumsum(np.r_[False, np.any([x[1:] != x[:-1] for x in cols], axis=0)])
        size = np.bincount(bucket)
        many = size[bucket] > 1
        u, v = GrayIndex(bucket[many], table.column("fp").to_numpy().view(np.uint64)[many], radius).connect()
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(x) for x in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(c).to_numpy() for c in ("choice", "bits", "part", "other")]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0))
        if len(cuts):  # the last bucket may go on in the next batch
            yield star(table.slice(0, int(cuts[-1]) + 1))
            held = table.slice(int(cuts[-1]) + 1).to_batches()
    if sum(len(x) for x in held):
        yield star(pa.Table.from_batches(held).combine_chunks())


def choices(blocks: tuple = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks: of each choice of as many blocks as two fingerprints within the radius must share."""
    at = [0, *accumulate(blocks)]
    masks = [((1 << n) - 1) << s for n, s in zip(blocks, at, strict=False)]
    return [sum(x) for x in combinations(masks, len(blocks) - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, blocks: tuple = BLOCKS, cap: int = CAP) -> DataFrame:
    """(u, v): stars that connect all distinct fingerprints (column fp) within the radius."""
    each = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for k, m in enumerate(choices(blocks, radius))])
    rows = fps.select("fp", F.inline(each))
    large = written(rows.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap), "simhash-large")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0)).withColumn("other", F.lit(0))
    else:
        parts = F.coalesce(F.ceil(F.col("n") * 2 / cap), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        rows = (
            rows.join(large, ["choice", "bits"], "left")
            .withColumn("parts", parts)
            .withColumn("own", own)
            .withColumn("meet", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("choice", "bits", F.least("own", "meet").alias("part"), F.greatest("own", "meet").alias("other"), "fp")
        )
    bucket = ["choice", "bits", "part", "other"]
    dealt = rows.select(*bucket, "fp").repartition(*bucket).sortWithinPartitions(*bucket)
    return dealt.mapInArrow(lambda batches: links_in(batches, radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for all u but the smallest; by large-star and small-star rounds.

    A round halves the longest way to a component's smallest node or better, so ROUNDS suffices for any number of nodes."""

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    mark = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(smallest(both), "simhash-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "simhash-large-stars")
        small = large.join(written(smallest(large), "simhash-least"), "u")
        stars = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(stars.distinct(), "simhash-stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return edges
        mark = now
    raise RuntimeError(f"components are not settled after {ROUNDS} rounds")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, blocks: tuple = BLOCKS, cap: int = CAP
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, and ``row_key`` of the source row."""
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    groups = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-groups")
    edges = written(links(groups.select("fp"), radius, blocks, cap), "simhash-links")
    stars = components(edges)
    nodes = stars.unionByName(stars.select(F.col("v").alias("u"), "v").distinct()).withColumnsRenamed({"u": "fp", "v": "root"})
    linked = groups.join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    found = linked.join(least, "root").select("fp", "component")
    known = written(groups.join(found, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "simhash-known")
    return rows.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")
