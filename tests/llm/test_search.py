"""SimHash groups, nearest neighbours, language ID and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import ann, lang_id, simhash
from cloakframe.llm.simhash import GrayIndex, components, fingerprint, merge, simhash_groups


def classes(fps, radius=4):
    label = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    merge(label, i[i < j], j[i < j])
    return label


@pytest.mark.parametrize("seed", range(4))
def test_gray_index(seed):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, size=[3, 40, 5, 1][seed], dtype=np.uint64)
    fps = centres[r.integers(0, len(centres), 2000)].copy()
    for _ in range([7, 6, 9, 12][seed]):
        fps ^= np.where(r.random(len(fps)) < 0.5, np.uint64(1) << r.integers(0, 64, len(fps)).astype(np.uint64), np.uint64(0))
    fps = np.unique(fps)
    u, v = GrayIndex(np.zeros(len(fps), int), fps).connect()
    label = np.arange(len(fps))
    merge(label, np.searchsorted(fps, u), np.searchsorted(fps, v))
    assert (label == classes(fps)).all()


def test_fingerprint():
    def plain(text):
        words = text.translate({k: k + 32 for k in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for t in ("", " \n", "One", "É a B c D e", "a b c d " * 50, "x\xa0y z w v u t s"):
        assert fingerprint(t.encode()) == plain(t)
    assert fingerprint(None) == 0


def near_texts(seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(40):
        base = r.choices(words, k=r.randint(1, 200))
        for _ in range(r.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "word " * 40000), (904, "word " * 40000), (None, "no id"), (905, "no id"), (905, "no id")]


@pytest.mark.parametrize("cap", [200_000, 20])
def test_simhash_groups(spark, cap):
    rows = near_texts()
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, fp string")
    got = simhash_groups(docs, cap=cap).collect()
    fps = np.array([fingerprint((t or "").encode()) for _, t in rows], np.uint64)
    label = classes(fps)
    want = []
    for k, (i, _) in enumerate(rows):
        want.append((i, f"{fps[k]:016x}", min((rows[j][0] for j in np.flatnonzero(label == label[k]) if rows[j][0] is not None), default=None)))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert simhash_groups(docs.limit(0)).count() == 0


def test_hot_buckets_are_split(spark):
    """Fingerprints that all share a bucket, with a cap that deals them into many parts."""
    r = np.random.default_rng(3)
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << r.integers(40, 64, (600, 6)).astype(np.uint64), axis=1))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(df, cap=50).collect()
    label = np.arange(len(fps))
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    merge(label, np.array([at[e.u] for e in edges]), np.array([at[e.v] for e in edges]))
    assert (label == classes(fps)).all()


def test_components(spark):
    chain = spark.range(1, 60).selectExpr("id AS u", "id - 1 AS v").unionByName(spark.createDataFrame([(105, 100), (104, 105)], "u long, v long"))
    got = {r.u: r.v for r in components(chain).collect()}
    assert got == {**dict.fromkeys(range(1, 60), 0), 104: 100, 105: 100}


def vectors(n=600, dim=12, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) * r.uniform(0.5, 2, (n, 1))
    x[100:160] = x[100]  # ties
    return x.astype(np.float32)


def test_nearest(spark):
    x = vectors()
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)]
    rows += [(1000, None, "c"), (1020, [0.0] * 12, "c"), (1040, [float("nan")] * 12, "c"), (1060, [1.0] * 3, "c"), (1080, [None] * 12, "c"), (1100, [], "c"), (1120, [float("inf")] * 12, "c"), (None, [1.0] * 12, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.nearest(df, lambda i: i % 20 == 0, cap=40)
    have = {}
    for r in got.orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(have) == set(range(0, 600, 20))
    y, hit = x.astype(float), 0
    for q, found in have.items():
        s = ann.inner(np.repeat(y[[q]], len(y), 0), y)
        assert all(score == s[v] and v != q for v, score in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20
        s[q] = -np.inf
        hit += len({v for v, _ in found} & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
    assert hit / (20 * len(have)) >= 0.9
    tied = [v for v, _ in have[120] if 100 <= v < 160]
    assert tied and tied == [v for v in range(100, 160) if v != 120][: len(tied)]  # ties to the smaller id
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 5"), lambda i: i % 20 == 0)
    assert few.count() <= 4


@pytest.mark.parametrize("lengths", ["one long", "spread"])
def test_nearest_of_unequal_lengths(spark, lengths):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x *= np.exp(r.normal(0, 0.7, (3000, 1))) if lengths == "spread" else 1
    x[7] *= 100
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    # Few tables, so that queries come out short and are answered again.
    for tables, least in ((ann.TABLES, 0.9), (1, 0)):
        have = {}
        for row in ann.nearest(df, lambda i: i % 60 == 0, tables=tables, probes=None if least else 1, cap=500, exact=100).collect():
            have.setdefault(row.query_id, set()).add(row.vec_id)
        assert set(have) == set(range(0, 3000, 60)) and all(len(f) == 20 for f in have.values())
        s = x[::60] @ x.T
        s[np.arange(50), np.arange(0, 3000, 60)] = -np.inf
        hit = sum(len(have[60 * q] & set(np.argsort(-s[q])[:20].tolist())) for q in range(50))
        assert hit / 1000 >= least


@pytest.mark.parametrize("two", [False, True])
def test_recall_at_64_dimensions(spark, two):
    """Vectors without any direction, searched by one axis and by pairs of axes, with buckets dealt into parts."""
    r = np.random.default_rng(6)
    x = r.normal(size=(5000, 64)).astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    have = {}
    for row in ann.nearest(df, lambda i: i % 50 == 0, cap=30, asked=7, pairs_from=1000 if two else 10**9).collect():
        have.setdefault(row.query_id, {})[row.vec_id] = row.score
    y = x.astype(float)
    s = y[::50] @ y.T
    s[np.arange(100), np.arange(0, 5000, 50)] = -np.inf
    assert set(have) == set(range(0, 5000, 50)) and all(len(f) == 20 for f in have.values())
    assert all(f[v] == float(ann.inner(y[[q]], y[[v]])[0]) for q, f in have.items() for v in f)
    assert sum(len(set(have[50 * q]) & set(np.argsort(-s[q])[:20].tolist())) for q in range(100)) / 2000 >= 0.9


def test_the_way_does_not_depend_on_the_size(spark):
    """Vectors that are nobody's neighbours, however many, change no result."""
    r = np.random.default_rng(8)
    x = r.normal(size=(6000, 64))
    x[:, 0] = 0
    x *= 0.8 / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[:, 0] = np.where(np.arange(6000) < 2500, 0.6, -0.6)
    got = []
    for n in (2500, 6000):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[:n])], "vec_id long, embedding array<double>")
        got.append(sorted(map(tuple, ann.nearest(df, lambda i: (i % 50 == 0) & (i < 2500)).collect())))
    assert got[0] == got[1] and len(got[0]) == 1000


def test_lengths_that_overflow(spark):
    """A vector whose squared length is no double takes part like any other."""
    r = np.random.default_rng(7)
    x = r.normal(size=(300, 8))
    x[5] *= 1e200
    rows = ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=5, exact=50).collect()
    have = {}
    for row in rows:
        have.setdefault(row.query_id, {})[row.rank] = row.vec_id
    s = x[::20] @ x.T
    s[np.arange(15), np.arange(0, 300, 20)] = -np.inf
    up = [q for q in range(15) if s[q, 5] > 0]
    assert up and all(have[20 * q][1] == 5 for q in up) and len(rows) == 75


def test_nearest_of_each_dimension(spark):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(400, 12)), r.normal(size=(30, 5))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v.tolist()) for k, v in enumerate(y)] + [(2000, [1.0] * 13)]
    have = {}
    for row in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, exact=100).collect():
        have.setdefault(row.query_id, set()).add(row.vec_id)
    assert set(have) == {*range(0, 400, 20), 1000, 1020} and all(len(f) == 20 for f in have.values())
    assert all((q >= 1000) == (v >= 1000) for q, f in have.items() for v in f)


def language_rows(n=240, seed=1):
    r = random.Random(seed)
    words = {"en": ["the", "and", "with", "think", "where", "ing"], "de": ["der", "und", "nicht", "straße", "über", "ein"], "fr": ["les", "être", "où", "ça", "dans", "avec"]}
    return [(k, " ".join(r.choices(words[lang], k=r.randint(5, 60))), lang, f"s{k % 3}") for k in range(n) for lang in [r.choice(list(words))]]


def test_language_id(spark):
    rows = language_rows() + [(901, None, "en", "a"), (902, "123 !?", "de", None), (903, "", None, "a"), (None, "the and with", None, "a"), (904, "über und " * 20000, None, "b")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, source string, score string")
    net = lang_id.train(docs, per_language=40)
    got = lang_id.annotate(docs, net).withColumn("out", lang_id.held_out("doc_id")).collect()
    tested = [r for r in got if r.out and r.lang and r.doc_id < 900]
    assert np.mean([r[lang_id.PRED] == r.lang for r in tested]) > 0.95
    by = {r.doc_id: r for r in got}
    assert all(by[k][lang_id.PRED] == "und" and by[k][lang_id.SCORE] == 0 for k in (901, 902, 903))
    assert by[904][lang_id.PRED] == "de" and by[None][lang_id.PRED] == "en" and all(0 <= r[lang_id.SCORE] <= 1 for r in got)
    empty = lang_id.train(docs.limit(0))
    assert empty.languages == [] and lang_id.annotate(docs.limit(3), empty).where(F.col(lang_id.PRED) != "und").count() == 0


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    rows = [(k, f"text {k:03d} of many", "en") for k in range(100)]
    h = {r.text: r.h for r in spark.createDataFrame(rows, "k long, text string, l string").select("text", F.xxhash64("text").alias("h")).collect()}
    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    first = min(learned, key=lambda x: h[x[1]])
    copies = [(k, first[1], "en") for k in range(1000, 1200)]  # they come first and fill the sample if each one counts
    seen = []
    monkeypatch.setattr(lang_id.Network, "fit", lambda self, windows, truth: seen.extend(w.tobytes().rstrip().decode() for w in windows))
    lang_id.train(spark.createDataFrame(rows + copies, "doc_id long, text string, lang string"), per_language=20)
    assert sorted(seen) == sorted(sorted({x[1] for x in learned}, key=h.get)[:20])


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 5000):
        data = bytes(k % 251 for k in range(n))
        windows, held = lang_id.cut(data)
        step = lang_id.WINDOW - max(lang_id.WIDTHS) + 1
        assert all(bytes(w)[: max(0, n - k * step)] == data[k * step : k * step + 256] for k, w in enumerate(windows))


def test_gradients_are_the_slopes():
    r = np.random.default_rng(1)
    net = lang_id.Network.new(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = r.integers(0, 256, (5, lang_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    grads = net.gradients(x, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = net.weights[k][at], 1e-5
        net.weights[k][at] = old + e
        up = loss()
        net.weights[k][at] = old - e
        slope = (up - loss()) / (2 * e)
        net.weights[k][at] = old
        assert abs(slope - g[at]) < 1e-4 + 0.01 * abs(slope)


def test_pipeline(spark, tmp_path):
    """Each stage against plain Python on its own input; all columns stay until the last."""
    rows = language_rows(200, 5)
    rows += [(500 + k, rows[0][1], "en", "s0") for k in range(30)] + [(700, None, "en", "s1"), (701, "...", "de", "s1"), (702, rows[1][1], None, None)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    clear = stages["language ID"](spark, docs, str(tmp_path)).cache()
    assert clear.columns == docs.columns and {r.doc_id for r in clear.collect()} == {i for i, t, _, _ in rows} - {700, 701}
    one = stages["exact dedup"](spark, clear, "").cache()
    last = {}
    for r in clear.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in one.collect()} == set(last.values()) and one.columns == docs.columns
    few = stages["SimHash near-dedup"](spark, one, "").cache()
    held = sorted((r.doc_id, fingerprint(r.text.encode())) for r in one.collect())
    label = classes(np.array([f for _, f in held], np.uint64))
    assert {r.doc_id for r in few.collect()} == {held[k][0] for k in set(label.tolist())} and few.columns == docs.columns
    mixed = stages["mixing"](spark, few, "").cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in few.collect()}
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    texts = {r.doc_id: r.text for r in few.collect()}
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    coded = stages["BPE"](spark, mixed, "")
    assert coded.count() == mixed.count() and coded.where("n_tokens = 0").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mixed.count()
    for name, stage in corpus_pipeline.STAGES:  # empty tables go through
        assert stage(spark, docs.limit(0), "").count() == 0, name
