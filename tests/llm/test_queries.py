"""The registered queries themselves, over a folder of small tables: contracts, SQL where there is some, odd rows, clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cloakframe.llm import bpe, common, queries, rans
from cloakframe.llm.simhash import fingerprint

WORDS = {"en": ["the", "and", "with", "think", "where", "ing"], "de": ["der", "und", "nicht", "straße", "über", "ein"], "fr": ["les", "être", "où", "ça", "dans", "avec"]}
CONTRACT = {
    "op1_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "removed_lines": "bigint", "text_sha256": "string"},
    "op1_line_dedup_single": {"doc_id": "bigint", "n_lines": "bigint", "removed_lines": "bigint", "text_sha256": "string"},
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, embeddings and pages, with columns whose names operators use too."""
    r, out = random.Random(3), tmp_path_factory.mktemp("sf")
    docs = []
    for k in range(150):
        lang = r.choice(list(WORDS))
        text = "\n".join(" ".join(r.choices(WORDS[lang], k=r.randint(1, 9))) for _ in range(r.randint(1, 8)))
        docs.append((k, text, lang, f"s{k % 4}"))
    docs += [(200 + k, docs[0][1], "en", "hot") for k in range(70)]
    docs += [(400, None, "en", None), (401, "", None, "s1"), (402, "...", "de", "s1"), (403, "über und " * 20000, "de", "long")]
    names = "doc_id long, text string, lang string, source string, __key string, key string, digest string, start long"
    spark.createDataFrame([(*d, "x", "y", "z", 7) for d in docs], names).write.parquet(f"{out}/documents.parquet")
    x = np.random.default_rng(1).normal(size=(300, 8))
    vectors = [(k, v.tolist(), "a") for k, v in enumerate(x)] + [(1000, None, "a"), (1020, [0.0] * 8, "b"), (1040, [1.0, None], "c")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string").write.parquet(f"{out}/embeddings.parquet")
    pages = [(k, f"http://a/{k}", r.choice(["<p>" + "x" * 200, "small", "é" * 60, str(k)]), "z") for k in range(80)] + [(90, None, None, None), (91, "u", "", "z")]
    spark.createDataFrame(pages, "page_id long, url string, html string, digest string").write.parquet(f"{out}/pages.parquet")
    return str(out), docs


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: query(spark, tables[0]).cache() for name, query in queries.queries().items()}


def test_contracts(results):
    assert set(results) == set(CONTRACT)
    for name, df in results.items():
        kinds = dict(df.dtypes)
        assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name], name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(results, tables, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables[0]}/{table}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in results[name].select(columns).collect())


def test_coders_agree_with_the_library(results, tables):
    docs = tables[1]
    library = Tokenizer.from_file(bpe.production_path())
    want = []
    for i, t, _, _ in docs:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4")
        back = library.decode(ids.tolist(), skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, results["op2_bpe"].collect())) == sorted(want)
    library, want, start = Tokenizer.from_file(rans.production_path()), [], 0
    for i, t, _, _ in sorted(docs):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, results["op8_token_files"].collect())) == want


def test_token_files_of_more_ranges_than_tasks(spark, tables, monkeypatch):
    """A task that writes several ranges of ids loses none of their files, and the files follow each other in the order of ids."""
    monkeypatch.setattr(common, "FILES", 1)
    changed = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, queries.queries()["op8_token_files"](spark, tables[0]).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    library, want, start = Tokenizer.from_file(rans.production_path()), [], 0
    for i, t, _, _ in sorted(tables[1]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_groups_and_shards(results, tables):
    docs = tables[1]
    fps = {i: fingerprint((t or "").encode()) for i, t, _, _ in docs}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in results["op10_simhash_near_dedup"].collect()}
    assert got == {i: (f"{fps[i]:016x}", root(i)) for i in fps}
    shards = results["op4_sharding"].collect()
    load, slots = Counter(), {}
    for r in shards:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert {r.doc_id: r.size for r in shards} == {i: len((t or "").encode()) + 8 for i, t, _, _ in docs}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(24))


def test_neighbours_and_languages(results, tables, spark):
    rows = results["op3_nearest_neighbours"].collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").where("vec_id < 300").collect()}
    for q in range(0, 300, 20):
        own = sorted(((float((x[q] * x[v]).sum()), -v) for v in x if v != q), reverse=True)[:20]
        assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] == [(-v, s) for s, v in own]
    langs = {i: lang for i, _, lang, _ in tables[1]}
    found = {r.doc_id: r for r in results["op6_language_id"].collect()}
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (400, 401, 402)) and found[403].lang_pred == "de"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    held = [i for i in range(150) if found[i].held_out]
    assert np.mean([found[i].lang_pred == langs[i] for i in held]) >= 0.9


def test_pipeline_with_clashing_names(spark, tables):
    """Columns that stages use names like go through, and the whole is what its stages make one after the other."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for extra in ("__key1", "__pred", "__score", "__copies", "__copy", "__found", "__place", "component_id", "row_key"):
        docs = docs.withColumn(extra, F.lit(extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, tables[0])
        assert kept.columns == docs.columns, name
        docs = kept.cache()
    assert docs.where("__key1 <> '__key1' OR __pred <> '__pred'").count() == 0 < docs.count()
    out = corpus_pipeline.run(spark, tables[0])
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect())
