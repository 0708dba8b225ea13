"""Line dedup, exact dedup, mixing and sharding against brute force, on small fixtures with every odd case."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cloakframe.llm.common import FILES, few_files, written
from cloakframe.llm.exact_dedup import exact_dedup
from cloakframe.llm.line_dedup import line_dedup
from cloakframe.llm.mixing import mix
from cloakframe.llm.sharding import deal, shard

SCHEMA = "doc_id long, text string, source string, key string, digest string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash", 7) for i, t, s in rows], SCHEMA)


def odd_rows(seed=1, n=120):
    r = random.Random(seed)
    lines = [f"line {k} " + "w " * (k % 5) for k in range(12)]
    rows = [(k, "\n".join(r.choices(lines, k=r.randint(1, 9))), r.choice(["b", "a", None, "é"])) for k in range(n)]
    rows += [(1000 + k, "copy one\ntwo\nthree\nfour", "hot") for k in range(60)]
    return rows + [(2000, None, "a"), (2001, "", None), (2002, " \t\n", "a"), (2003, "word " * 30000, "long"), (2003, "word " * 30000, "long"), (None, "no id", "a"), (None, None, None)]


def lines_brute(rows, run=3):
    first = {}
    places = sorted({((i is not None, i or 0), t) for i, t, _ in rows if t is not None}, key=lambda x: (x[0], x[1]))
    for i, t in places:
        x = t.split("\n")
        for s in range(len(x) - run + 1):
            w = tuple(x[s : s + run])
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = {}
    for i, t in places:
        x = t.split("\n")
        gone = {s + k for s in range(len(x) - run + 1) if first[tuple(x[s : s + run])] < (i, s) for k in range(run)}
        out[(i, t)] = ("\n".join(v for k, v in enumerate(x) if k not in gone), len(gone))
    return out


def test_line_dedup(spark):
    rows = odd_rows()
    want = lines_brute(rows)
    got = line_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.text, r.removed_lines))
    expect = defaultdict(list)
    for i, t, _ in rows:
        expect[i].append((None, 0) if t is None else want[((i is not None, i or 0), t)])
    assert {k: sorted(v, key=str) for k, v in have.items()} == {k: sorted(v, key=str) for k, v in expect.items()}
    assert line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_of_single_lines(spark):
    rows = odd_rows() + [(3000, "one line", "a"), (3001, "one line", "a"), (3002, "one line\nof two", "a"), (3003, "\n \nnew\n\nof two", "a")]
    first, want = {}, []
    places = sorted({((i is not None, i or 0), t) for i, t, _ in rows if t is not None})
    for i, t in places:
        for n, x in enumerate(t.split("\n")):
            first[x] = min(first.get(x, (i, n)), (i, n))
    for i, t, _ in rows:
        place = (i is not None, i or 0)
        stays = [x for n, x in enumerate(t.split("\n")) if not x.strip() or first[x] == (place, n)] if t is not None else None
        want.append((i, None if t is None else "\n".join(stays), 0 if t is None else t.count("\n") + 1 - len(stays)))
    got = [(r.doc_id, r.text, r.removed_lines) for r in line_dedup(frame(spark, rows), run=1, blank=False).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (3001, "", 1) in got and (3003, "\n \nnew\n", 1) in got


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = odd_rows(2)
    # A digest of one hexadecimal digit: nearly every hit is a collision that only the bytes tell apart.
    digest = (lambda t: F.substring(F.md5(t), 1, 1)) if weak else (lambda t: F.sha2(t, 256))
    got = exact_dedup(frame(spark, rows), digest=digest).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(by, 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_if_sha256_collides(spark, monkeypatch):
    rows = odd_rows(2)
    # One hexadecimal digit in the place of SHA-256, so text_sha256 collides where the digest does.
    monkeypatch.setattr(F, "sha2", lambda t, bits: F.substring(F.md5(t), 1, 1))
    got = exact_dedup(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = [(i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def targets_brute(sizes):
    """Clamp, share the excess by weight, and again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("cut", [True, False])
def test_mixing(spark, cut):
    rows = odd_rows(3)
    docs = frame(spark, rows)
    got = mix(docs, cut=cut).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets_brute(sizes)
    source = {i: s for i, _, s in rows if i is not None}
    assert sorted(r.size for r in got) == sorted(size(t) for _, t, _ in rows)
    taken = Counter()
    for r in got:
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        else:
            s = next(s for i, t, s in rows if i is None and size(t) == r.size)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    largest = max(size(t) for _, t, _ in rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (1 if cut else largest / 2 + 1)
    again = mix(docs.repartition(3), cut=cut).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix(frame(spark, [])).count() == 0 and {r.taken for r in mix(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()} == {0}


def heap_brute(loads, size, count):
    heap = [(x, j) for j, x in enumerate(loads)]
    heapq.heapify(heap)
    got = [0] * len(loads)
    for _ in range(count):
        x, j = heapq.heappop(heap)
        got[j] += 1
        heapq.heappush(heap, (x + size, j))
    return got, [x for x, _ in sorted(heap, key=lambda y: y[1])]


def test_deal_is_what_the_heap_does():
    r = random.Random(4)
    for _ in range(300):
        loads = [r.randint(0, 200) for _ in range(r.randint(1, 9))]
        size, count = r.randint(1, 40), r.randint(0, 120)
        got, after = heap_brute(loads, size, count)
        mine = list(loads)
        assert deal(mine, size, count) == got and mine == after


def test_sharding(spark):
    rows = odd_rows(5)
    got = shard(frame(spark, rows), buckets=4).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    groups = Counter()
    for _, t, _ in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    loads = [0] * 24
    for g in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += g
    have, where, slots = Counter(), defaultdict(set), defaultdict(list)
    text = {i: t or "" for i, t, _ in rows}
    for r in got:
        have[r.shard] += r.size
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            where[text[r.doc_id]].add(r.shard)
    assert sorted(have.values()) == sorted(x for x in loads if x)
    assert all(len(v) == 1 for v in where.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shard(frame(spark, [])).count() == 0


def test_few_files(spark, tmp_path):
    """Small tables are written in few files, whatever their partitions; large ones keep theirs."""
    many = spark.range(1000).repartition(500)
    assert few_files(many).rdd.getNumPartitions() == FILES * spark.sparkContext.defaultParallelism
    assert few_files(many, spark.range(1 << 40)).rdd.getNumPartitions() == 500
    assert written(many, "few").count() == 1000
