"""The engine on Spark: vault, redactor, bodies, sources, streams."""

import gzip
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import detectors, entities, formats
from cloakframe.functions.patterns import DETECTORS
from cloakframe.operators import admin, detect, json_body, resolve
from cloakframe.operators.rules import Rules, Watcher
from cloakframe.operators.vault import Vault, VaultFull
from cloakframe.plans import plants
from cloakframe.plans.redactor import Redactor, differences, register_functions
from cloakframe.sources import bodies
from cloakframe.streaming import sse

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
KEY = "gh" + "p_" + "0123456789abcdef0123456789abcdef01234567"
TEXTS = [
    "mail.acmeco.co.uk and bob@acmeco.com", "10.1.2.3/24 then 10.1.2.9, 10.9.9.9", f"key {KEY}.", "db_password: hunter22x", "box/acmeco.org", "api.github.com",
    "call 415-867-5309 or +44 20 7946 0018", "2600:abcd::1 1c:02:03:04:05:06", None, "", "mail.acmeco.co.uk and bob@acmeco.com",
]


@pytest.fixture
def vault(spark, tmp_path):
    return Vault(spark, f"file://{tmp_path}")


def rows(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def texts(df):
    return [r.text for r in df.orderBy("id").collect()]


def test_there_and_back(spark, vault):
    r = Redactor(spark, vault)
    done = r.tokenize(rows(spark), "id", "text")
    hidden = texts(done.rows)
    assert all(x not in (t or "") for t in hidden for x in ("acmeco.co", "bob", "10.1.2", KEY, "hunter22x", "867-5309", "7946", "abcd", "1c:02"))
    assert hidden[4:6] == ["box/acmeco.org", "api.github.com"] and hidden[8:10] == [None, ""] and hidden[0] == hidden[10]
    back = texts(r.detokenize(done.rows, "text"))
    assert [b for k, b in enumerate(back) if k != 6] == [t for k, t in enumerate(TEXTS) if k != 6] and back[6] == "call 415-867-5309 or +442079460018"
    assert done.rejects.count() == 0 and done.audit.where("real = 'hunter22x'").count() == 1
    again = r.tokenize(done.rows, "id", "text")
    assert texts(again.rows) == hidden  # idempotent
    later = texts(r.tokenize(rows(spark, ["it is hunter22x", "box/acmeco.org", "acmeco.org"]), "id", "text").rows)
    assert later[0].startswith("it is FAKE-PASSWORD-") and "acmeco" not in later[2]
    assert later[1] == "box/acmeco.org"  # the vault as of the beginning of the batch


def test_known_values(spark, vault):
    r = Redactor(spark, vault)
    r.tokenize(rows(spark, ["password: hunter22x", "password: 'two words 9'", "password: 'ab1-cd'", "password: ab1-cd-ef2"]), "id", "text").rows.count()
    got = texts(r.tokenize(rows(spark, ["so hunter22x!", "hunter22xy", "x two words 9", "x ab1-cd-ef2z y", "x ab1-cd-ef2 y", "hunter22x" * 2]), "id", "text").rows)
    assert "hunter22x" not in got[0] and got[1] == "hunter22xy" and "two words" not in got[2] and got[5] == "hunter22x" * 2
    # The longest value that stands alone: 'ab1-cd' does beside a hyphen, 'ab1-cd-ef2' doesn't before a letter.
    assert got[3].endswith("-ef2z y") and "ab1-cd" not in got[3] and got[4].startswith("x FAKE-PASSWORD-") and got[4].endswith(" y") and "-ef2" not in got[4]


def test_placeholders_that_stand_by_chance(spark, vault):
    """A text's own '415-555-0118' is never minted for a number, of its batch or of later ones."""
    numbers = [f"call {200 + k // 100 * 10 + 2}-867-{k:04d} now" for k in range(500)]
    chance = [f"call {area}-555-01{n:02d} now" for area in range(202, 210) for n in range(100)]
    r = Redactor(spark, vault)
    for batch in (numbers[:250] + chance, numbers[250:]):
        done = r.tokenize(rows(spark, batch), "id", "text")
        assert texts(r.detokenize(done.rows, "text")) == batch
    assert vault.entries().count() == 500 and r.detokenize(rows(spark, chance), "text").select("text").exceptAll(rows(spark, chance).select("text")).count() == 0


@pytest.mark.parametrize("text", ["+1-555-1234 and +44 20 7946 0018", "02:00:00:aa:bb:cc 1c:02:03:04:05:06", "FAKEP1234Z ABCPK1234Z", "0000 1234 5678 and 2938 4756 1028"])
def test_small_shapes_by_chance(spark, vault, text):
    r = Redactor(spark, vault)
    done = r.tokenize(rows(spark, [text]), "id", "text")
    assert texts(r.detokenize(done.rows, "text")) == [text.replace("+44 20 7946 0018", "+442079460018")]


def test_fails_closed(spark, vault):
    def broken(text):
        if "bad" in text:
            raise RuntimeError(text)
        return ()

    detect.register_detector("broken", broken)
    try:
        done = Redactor(spark, vault).tokenize(rows(spark, ["good", "bad acmeco.com"]), "id", "text")
        assert texts(done.rows) == ["good"] and [tuple(x) for x in done.rejects.collect()] == [(1, "RuntimeError")]
    finally:
        detect.REGISTERED.clear()


def test_rules(spark, vault):
    rules = Rules(block=[{"value": "acme"}], allow=[{"value": "keepme.com"}])
    done = Redactor(spark, vault, rules).tokenize(rows(spark, ["www.acme.e77.edgekey.net", "x keepme.com acmeworld"]), "id", "text")
    a, b = texts(done.rows)
    assert a.startswith("www.tok-blocked-") and a.endswith(".e77.edgekey.net") and b.startswith("x keepme.com tok-blocked-") and b.endswith("world")
    off = Redactor(spark, vault, Rules().without("network.ipv4"))
    assert texts(off.tokenize(rows(spark, ["10.1.2.3"]), "id", "text").rows) == ["10.1.2.3"]


def wanted(spark, pairs):
    return spark.createDataFrame([(r, e, k) for k, (r, e) in enumerate(pairs)], "real string, entity_type string, place int")


def test_vault(spark, vault):
    pairs = [("a", "github_token"), ("b", "phone"), ("10.0.0", "ip_network"), ("10.0.1", "ip_network"), ("a", "password")]
    first = {r.real: r.token for r in vault.get_or_create(wanted(spark, pairs)).collect()}
    assert first["a"].startswith("ghp_FAKE") and (first["10.0.0"], first["10.0.1"]) == ("198.18.0", "198.18.1") and len(set(first.values())) == 4
    again = Vault(spark, vault.base.rpartition("/")[0])
    assert {r.real: r.token for r in again.get_or_create(wanted(spark, [*pairs, ("10.0.2", "ip_network")])).collect()} == first | {"10.0.2": "198.18.2"}
    assert {r.entity_type: r.n for r in vault.report().collect()} == {"github_token": 1, "phone": 1, "ip_network": 3, None: 5}
    vault.remove(spark.createDataFrame([("a",), ("10.0.0",)], "real string"))
    assert vault.lookup(spark.createDataFrame([("a",)], "real string")).first().token is None and vault.spans().count() == 5
    new = {r.real: r.token for r in vault.get_or_create(wanted(spark, [("a", "github_token"), ("10.0.0", "ip_network")])).collect()}
    assert new["a"] not in first.values() and new["10.0.0"] == "198.18.3"
    assert [r.real for r in vault.listed().collect()][:1] == ["b"] or vault.listed().count() == 5


def test_batches_are_repeatable(spark, vault):
    w = wanted(spark, [("10.0.0", "ip_network")])
    vault.get_or_create(w, "one")
    vault.append(vault.history(), "one")
    vault.get_or_create(w, "one")
    assert vault.batches() == ["one"] and vault.entries().count() == 1 == len(vault.state()[1])
    # A name that another batch had, with values of its own: none of them goes without a placeholder.
    assert vault.get_or_create(wanted(spark, [("10.0.9", "ip_network")]), "one").first().token == "198.18.1" and vault.batches() == ["one"]


def test_a_crash_at_each_step_loses_nothing(spark, vault, monkeypatch):
    """Whatever step of a commit is the last one, what counted before still counts, and the batch can run again."""
    vault.get_or_create(wanted(spark, [("a", "github_token"), ("10.0.0", "ip_network")]))
    before = {r.real: r.token for r in vault.entries().collect()}

    class Crash(Exception):
        pass

    def crash(*args, **more):
        raise Crash

    for owner, step in ((vault, "_write"), (vault, "_take"), (vault, "_commit"), (os, "link")):
        with monkeypatch.context() as m:
            m.setattr(owner, step, crash)
            with pytest.raises(Crash):
                vault.get_or_create(wanted(spark, [("b", "github_token"), ("10.0.1", "ip_network")]), "batch")
        assert {r.real: r.token for r in Vault(spark, vault.base.rpartition("/")[0]).entries().collect()} == before
    again = {r.real: r.token for r in vault.get_or_create(wanted(spark, [("b", "github_token"), ("10.0.1", "ip_network")]), "batch").collect()}
    assert again["10.0.1"] == "198.18.1" and vault.entries().count() == 4


def test_two_writers(spark, vault, monkeypatch):
    """A writer that comes second mints anew on what the first one did; both batches count."""
    other, mint, first = Vault(spark, vault.base.rpartition("/")[0]), vault.mint, []

    def late(*args):
        done = mint(*args)
        if not first:
            first.append({r.real: r.token for r in other.get_or_create(wanted(spark, [("a", "github_token"), ("10.0.1", "ip_network")]), "other").collect()})
        return done

    monkeypatch.setattr(vault, "mint", late)
    own = {r.real: r.token for r in vault.get_or_create(wanted(spark, [("a", "github_token"), ("10.0.2", "ip_network")]), "own").collect()}
    assert vault.batches() == ["other", "own"] and own["a"] == first[0]["a"] and first[0]["10.0.1"] == "198.18.0" and own["10.0.2"] == "198.18.1"
    assert vault.entries().count() == 3 == vault.entries().select("token").distinct().count()


def test_compaction_and_salt(spark, vault, tmp_path):
    for k in range(3):
        vault.get_or_create(wanted(spark, [(f"v{k}", "github_token")]), f"n{k}")
    before = sorted(map(tuple, vault.history().collect()))
    vault.compact()
    assert len(vault.state()[1]) == 1 and vault.batches() == ["n0", "n1", "n2"] and sorted(map(tuple, vault.history().collect())) == before
    assert len(vault.salt) == 64 and Vault(spark, vault.base.rpartition("/")[0]).salt == vault.salt
    assert Vault(spark, f"file://{tmp_path}/else").salt != vault.salt


def test_small_spaces_and_full_ones(spark, vault):
    many = spark.range(3000).selectExpr("concat('v', id) AS real", "'phone' AS entity_type", "id AS place")
    got = vault.get_or_create(many)
    assert got.select("token").distinct().count() == 3000
    nets = spark.range(513).selectExpr("concat('n', id) AS real", "'ip_network' AS entity_type", "id AS place")
    with pytest.raises(VaultFull):
        vault.get_or_create(nets)
    assert vault.entries().count() == 3000


def found_by(texts, mask):
    """All detections of texts as the scan gives them, or as the detectors do without the native filter before them."""
    if mask:
        got = texts.select("t", F.explode(detect.scan(F.col("t"), Rules().compiled())["dets"]).alias("d")).select("t", "d.start", "d.end", "d.det_ord").collect()
        return sorted((r.t, r.start, r.end, r.det_ord) for r in got)
    return sorted((r.t, d.start, d.end, d.order) for r in texts.collect() for d in detectors.detect(r.t or ""))


def test_the_native_filter_loses_nothing(spark):
    keys = spark.range(1, 200).withColumnRenamed("id", "c_custkey")
    forms = keys.select(F.expr(plants.form_text()).alias("t"))
    for name in plants.PLANTS:
        forms = forms.unionByName(keys.where("c_custkey < 20").select(F.expr(plants.planted_text(name)).alias("t")))
    if Path(DOCUMENTS).exists():
        forms = forms.unionByName(spark.read.parquet(DOCUMENTS).select(F.col("text").alias("t")))
    forms = forms.cache()
    assert found_by(forms, True) == found_by(forms, False)


def test_native_patterns_agree_with_the_detectors(spark):
    """Pattern detectors in the JVM find what those of the scan find."""
    keys = spark.range(1, 60).withColumnRenamed("id", "c_custkey")
    for d in DETECTORS:
        if d.name not in detectors.PROCEDURES:
            texts = keys.select(F.expr(plants.planted_text(d.name)).alias("t"))
            native = sorted(r.v for r in texts.select(F.explode(detect.matches(F.col("t"), d)).alias("v")).collect())
            assert native == sorted(r.t[x.start : x.end] for r in texts.collect() for x in detectors.plain(d, r.t) for x in [detectors.Detection(x[0], x[1], 0, ())]) and len(native) == 40


def test_every_placeholder_may_be_restored(spark):
    tokens = [entities.placeholder(e, f"v{k}") for e in entities.SHAPES for k in range(5)]
    tokens += [f"{entities.network_slot(k, True)}.7" for k in (0, 300, 600, 40000)] + [f"{entities.network6_slot(9)}::1", entities.placeholder("razorpay_key", "x").upper()]
    found = rows(spark, [f"see {t} now" for t in tokens] + ["nothing", ""]).select("text", detect.may_restore(F.col("text")).alias("m")).collect()
    assert all(r.m for r in found if "see" in r.text) and all(formats.candidates(r.text) for r in found if "see" in r.text and "+" not in r.text and "555-" not in r.text)
    assert [r.m for r in found if "see" not in r.text] == [False, False]


def test_overlaps(spark):
    df = spark.createDataFrame([([(0, 6, 2, 0), (0, 3, 0, 1), (5, 9, 1, 2), (9, 10, 3, 3)],)], "dets array<struct<start:int,end:int,det_ord:int,seq:int>>")
    kept = df.select(resolve.resolve_overlaps(F.col("dets")).alias("k")).first().k
    assert [(d.start, d.end) for d in kept] == [(0, 6), (9, 10)]
    left = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5)], "k int, start int, end int")
    right = spark.createDataFrame([(1, 4, 5), (2, 5, 6)], "k int, start int, end int")
    got = resolve.overlap_antijoin(left, right, ["k"], 2).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 9), (2, 0, 5)]


def test_bodies(spark, vault):
    good = json.dumps({"system": "10.1.1.1", "messages": [{"content": f"use {KEY}<é>"}, {"content": [{"type": "tool_use", "input": {"10.2.2.2": [1.50, "10.2.2.9"]}}]}]})
    df = spark.createDataFrame([(1, good), (2, '{"a":1,"a":1}'), (3, None), (4, '{"messages":[]}')], "id int, body string")
    r = Redactor(spark, vault)
    done, rejects = json_body.tokenize_bodies(r, df, "id", "body")
    by = {x.id: x.body for x in done.collect()}
    assert set(by) == {1, 3, 4} and by[4] == '{"messages":[]}' and "10.1.1.1" in by[1] and KEY not in by[1] and "10.2.2" not in by[1]
    assert [tuple(x) for x in rejects.collect()] == [(2, "a key is repeated")]
    back = {x.id: x.body for x in json_body.detokenize_bodies(r, done.unionByName(df.where("id = 2")), "id", "body").collect()}
    assert json.loads(back[1]) == json.loads(good) and back[2] == '{"a":1,"a":1}'


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"x" * 50))
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"x" * 500))
    (tmp_path / "d.gz").write_bytes(gzip.compress(b"x" * 50)[:-9])
    (tmp_path / "e.txt").write_bytes(b"\xff")
    good, bad = bodies.read_bodies(spark, str(tmp_path), limit=100)
    assert sorted(r.body for r in good.collect()) == ["x" * 50, "{}"]
    assert sorted(r.error for r in bad.collect()) == ["invalid UTF-8", "over the size limit", "the gzip stream ends early"]
    df = spark.createDataFrame([("{}", None), ("﻿ [", "text/plain"), ("x", "application/json; a=b"), ("x", None)], "b string, m string")
    assert [r[0] for r in df.select(bodies.is_json(F.col("b"), F.col("m"))).collect()] == [True, True, True, False]
    stream = "event: a\ndata: 1\ndata: 2\n\ndata: 3"
    frames = spark.createDataFrame([(stream,)], "t string").select(F.explode(bodies.parse_frames(F.col("t"))).alias("f")).select("f.*")
    assert [tuple(r) for r in frames.collect()] == [("a", "1\n2"), ("", "3")]
    assert frames.select(bodies.format_frame(F.col("event"), F.col("data"))).first()[0] == "event: a\ndata: 1\ndata: 2\n\n"
    events = spark.createDataFrame([("new_value", "a"), ("replacement", "b"), ("full_body", "c")], "event string, v string")
    bodies.write_audit(events, str(tmp_path / "audit"), "replacement")
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_boundaries():
    assert sse.flush_boundary("a b") == 2 and sse.flush_boundary("") == 0
    long = "é" * 100
    cut = sse.flush_boundary(long)
    assert len(long[cut:].encode()) <= sse.HOLD + 1 and cut
    assert sse.safe_point("x -----BEGIN RED") == 2 and sse.safe_point("plain.") == 6 and sse.safe_point("see 0000 12") == 4


def frames(text, size, index=0):
    yield {"type": "content_block_start", "index": index, "content_block": {"type": "text", "text": ""}}
    for k in range(0, len(text), size):
        yield {"type": "content_block_delta", "index": index, "delta": {"type": "text_delta", "text": text[k : k + size]}}
    yield {"type": "content_block_stop", "index": index}


def numbered(stream_id, events):
    return [json.dumps({"stream_id": stream_id, "seq": k, "event": e["type"], "data": json.dumps(e)}) for k, e in enumerate(events)]


def run_stream(query):
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()


def stream_of(spark, folder):
    return spark.readStream.schema("stream_id string, seq long, event string, data string").option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_rechunk(spark, tmp_path, size):
    """Placeholders that arrive in pieces leave in one, and what leaves is what came, in whatever order its batches come."""
    token = "ghp_FAKE" + "0123456789abcdef" * 2
    pem = f"-----BEGIN REDACTED PRIVATE KEY-----\n{'0f' * 24}\n-----END REDACTED PRIVATE KEY-----"
    text = f"a {token} b {pem} 0000 1234 5678 end {token}"
    lines = [x for s in ("s1", "s2") for x in numbered(s, [*frames(text, size), {"type": "message_stop"}])]
    (tmp_path / "in").mkdir()
    half = len(lines) // 2 + 3
    for k, part in enumerate((lines[half:], lines[:half], lines[half - 2 : half + 2])):  # the later half first, then some frames again
        file = tmp_path / "in" / f"{k}.json"
        file.write_text("\n".join(part))
        os.utime(file, (1_000_000 + k, 1_000_000 + k))
    name = f"chunks{size}"
    run_stream(sse.rechunk(stream_of(spark, tmp_path / "in")).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")))
    got = spark.table(name).orderBy("stream_id", "seq", "part").collect()
    for s in ("s1", "s2"):
        parts = [r.text for r in got if r.stream_id == s]
        assert "".join(parts) == text
        for whole, n in ((token, 2), (pem, 1), ("0000 1234 5678", 1)):
            assert sum(p.count(whole) for p in parts) == n
        assert [json.loads(r.data)["type"] for r in got if r.stream_id == s and r.kind == "frame"] == ["content_block_start", "content_block_stop", "message_stop"]


def test_restored_stream(spark, tmp_path, vault):
    """What a client puts together from restored frames is what was tokenized; all other frames come through."""
    r = Redactor(spark, vault)
    texts_in = [f"use {KEY} at mail.acmeco.com, 10.1.2.3", "call 415-867-5309 and\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- x"]
    hidden = texts(r.tokenize(rows(spark, texts_in), "id", "text").rows)
    tool = json.dumps({"cmd": hidden[0], "n": [1.25, {"k": hidden[1]}]}).replace("1.25", "1.250")
    start = lambda i, kind, **more: {"type": "content_block_start", "index": i, "content_block": {"type": kind, **more}}
    events = [{"type": "message_start"}, start(0, "thinking"), {"type": "content_block_delta", "index": 0, "delta": {"type": "thinking_delta", "thinking": hidden[0]}}, {"type": "content_block_stop", "index": 0}]
    events += [*frames(hidden[0], 4, 1), start(2, "tool_use", name="t")]
    events += [{"type": "content_block_delta", "index": 2, "delta": {"type": "input_json_delta", "partial_json": tool[k : k + 5]}} for k in range(0, len(tool), 5)]
    events += [{"type": "content_block_stop", "index": 2}, start(3, "text", text=hidden[1]), {"type": "error"}]
    (tmp_path / "in").mkdir()
    lines = numbered("s", events)
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines[k::3]))
    run_stream(sse.restore_stream(r, stream_of(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")))
    out = [json.loads(x.data) for x in spark.read.parquet(str(tmp_path / "out")).orderBy("seq", "part").collect()]
    of = lambda i, name: "".join(e["delta"].get(name, "") for e in out if e["type"] == "content_block_delta" and e["index"] == i)
    assert of(1, "text") == texts_in[0] and of(3, "text") == texts_in[1] and of(0, "thinking") == hidden[0]
    assert json.loads(of(2, "partial_json")) == {"cmd": texts_in[0], "n": [1.25, {"k": texts_in[1]}]} and "1.250" in of(2, "partial_json")
    assert [e["type"] for e in out if e["type"] != "content_block_delta"] == [e["type"] for e in events if e["type"] != "content_block_delta"]
    assert [e for e in out if e["type"] == "content_block_start"][3]["content_block"]["text"] == ""


def test_many_short_streams_share_their_calls(spark, tmp_path):
    """State, and with it a call of Python, is kept for a bucket of streams: 5,000 streams make no 5,000 calls a batch."""
    (tmp_path / "in").mkdir()
    lines = [x for s in range(5000) for x in numbered(f"s{s}", [*frames(f"no {s}", 9), {"type": "message_stop"}])]
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines[k::2]))
    query = sse.rechunk(stream_of(spark, tmp_path / "in")).writeStream.format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= sse.BUCKETS < 5000
    got = {r.stream_id: (r.text, r.n) for r in spark.table("many").groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "text"))), lambda x: x["text"]), "").alias("text"), F.count_if(F.col("kind") == "frame").alias("n")).collect()}
    assert got == {f"s{s}": (f"no {s}", 3) for s in range(5000)}


def test_gaps_and_limits(monkeypatch):
    frame = lambda seq, event: (seq, *(lambda e: (e[0], e[1], e[2], e[3]))(sse.read_event(json.dumps(event))), event["type"], json.dumps(event))
    events = [*frames("one two three", 4)]
    s = sse.Stream("s", None)
    s.come([frame(k, e) for k, e in enumerate(events) if k != 2])
    held = sse.Stream("s", s.held())
    assert len(held.wait) == len(events) - 3 and not held.come([frame(0, events[0])])
    held.give_up()
    assert "".join(x[5] for x in s.out + held.out) == "one three"
    monkeypatch.setattr(sse, "WAITING", 2)
    s = sse.Stream("s", None)
    s.come([frame(k, e) for k, e in enumerate(events) if k != 1])
    assert "".join(x[5] for x in s.out) == "two three"
    monkeypatch.setattr(sse, "BODY_BYTES", 10)
    s = sse.Stream("s", None)
    tool = [{"type": "content_block_start", "index": 0, "content_block": {"type": "tool_use"}}]
    tool += [{"type": "content_block_delta", "index": 0, "delta": {"type": "input_json_delta", "partial_json": "x" * 8}} for _ in range(3)] + [{"type": "content_block_stop", "index": 0}]
    s.come([frame(k, e) for k, e in enumerate(tool)])
    assert [(x[4], x[5]) for x in s.out if x[4] == "verbatim"] == [("verbatim", "x" * 16)] and len(s.out) == 4


def test_stream_tokenize_is_batch_tokenize(spark, tmp_path):
    src = tmp_path / "src"
    rows(spark, TEXTS[:4]).coalesce(1).write.parquet(str(src))
    rows(spark, [f"again {KEY}"]).coalesce(1).write.mode("append").parquet(str(src))
    rules = tmp_path / "rules.json"
    Rules().save(str(rules))
    r = Redactor(spark, Vault(spark, f"file://{tmp_path}/v"))
    stream = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = sse.tokenize_stream(r, stream, "id", "text", str(tmp_path / "out"), str(tmp_path / "cp"), Watcher(str(rules))).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((x.text or "") for x in spark.read.parquet(str(tmp_path / "out/rows")).select("text").collect())
    want = Redactor(spark, Vault(spark, f"file://{tmp_path}/v")).tokenize(spark.read.parquet(str(src)), "id", "text")
    assert got == sorted((x.text or "") for x in want.rows.collect())


def test_sql_functions(spark, vault):
    text = f"{KEY} 10.1.2.3 at mail.acmeco.co.uk, box/otherco.org"
    register_functions(spark)
    assert spark.sql(f"SELECT size(detect('{KEY} 10.1.2.3')) AS n").first().n == 2
    got = spark.sql(f"SELECT category, value FROM detections('{text}') ORDER BY start").collect()
    assert [tuple(r) for r in got][:3] == [("vcs.github", KEY), ("network.ipv4", "10.1.2.3"), ("network.domain", "mail.acmeco.co.uk")]
    r = Redactor(spark, vault)
    want = texts(r.tokenize(rows(spark, [text]), "id", "text").rows)[0]
    register_functions(spark, vault=vault)
    rows(spark, [text, None, want]).createOrReplaceTempView("t")
    assert [x[0] for x in spark.sql("SELECT tokenize(text) FROM t ORDER BY id").collect()] == [want, None, want]
    assert [x[0] for x in spark.sql("SELECT detokenize(tokenize(text)) FROM t ORDER BY id").collect()] == [text, None, text]
    with pytest.raises(Exception, match="without a placeholder"):
        spark.sql("SELECT tokenize('10.9.9.9')").collect()


def test_lines_and_differences(spark, tmp_path, vault):
    r = Redactor(spark, vault)
    hidden = texts(r.tokenize(rows(spark, [f"use {KEY}"]), "id", "text").rows)[0]
    lines = [json.dumps({"k": hidden, "n": k}) if k % 3 else "" for k in range(3000)]
    for name in ("a", "b"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = bodies.restore_lines(r, bodies.read_lines(spark, str(tmp_path / "in"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({x.path for x in got}) == 2 and len(got) == 6000
    for x in got:
        assert x.line == (json.dumps({"k": f"use {KEY}", "n": x.line_no}) if x.line_no % 3 else "")
    a, b = rows(spark, ["same", "abcXdef", None, "x"]), rows(spark, ["same", "abcYdef", "", "x"])
    assert sorted(map(tuple, differences(a, b, "id", "text").collect())) == [(1, 3, "Xdef", "Ydef"), (2, 0, None, "")]


def test_bodies_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"k":{k}}}')
    out = bodies.stream_bodies(spark, str(tmp_path / "in"), at_once=2)
    run_stream(out.writeStream.foreachBatch(lambda df, n: bodies.write_bodies(df.withColumn("n", F.lit(n)), str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")))
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 5 and got.select("n").distinct().count() == 3


def test_administration(spark, vault, tmp_path):
    vault.get_or_create(wanted(spark, [("alpha", "github_token"), ("beta", "password")]))
    token = admin.show(vault, "alpha")["token"]
    assert token.startswith("ghp_FAKE") and admin.show(vault, "nobody") is None
    assert [r.real for r in admin.tokens(vault, holding="BET").collect()] == ["beta"] and admin.tokens(vault, "github_token").count() == 1
    assert admin.remove(vault, [token, "nobody"]) == ["alpha"] and admin.tokens(vault).count() == 1 and vault.spans().count() == 2
    path = str(tmp_path / "rules.json")
    assert admin.change_rules(path, lambda r: r.add("block", "acme")) and admin.rules_listed(path) == [("block", "acme", False)]
    with pytest.raises(ValueError):
        admin.change_rules(path, lambda r: r.add("allow", "ACME"))
    with pytest.raises(ValueError):
        Rules(block=[{"value": "(?P<n>x)(?P=n)", "regex": True}]).validate(spark)
    assert admin.rules_listed(path) == [("block", "acme", False)]


def test_entry_without_the_optional_parts(tmp_path):
    """In a copy without the optional subpackage, with the pipeline beside it or gone too, the other queries are listed and run."""
    repo, copy = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    shutil.copytree(repo, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("cloakframe/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q), q.keys()"
    env = os.environ | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env=env)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env=env)


def test_entry_hides_no_error(tmp_path):
    """Only a missing subpackage is forgiven: an error inside of it, or of the pipeline, is raised."""
    repo, copy = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    shutil.copytree(repo, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    (copy / "cloakframe/llm").mkdir(exist_ok=True)
    (copy / "cloakframe/llm/__init__.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr
