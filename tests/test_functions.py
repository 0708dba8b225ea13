"""Scalar functions and detectors, without Spark."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cloakframe.functions import entities, formats, hosts, numbers
from cloakframe.functions.detectors import detect, starts
from cloakframe.functions.patterns import DETECTORS
from cloakframe.plans.plants import PLANTS

H = hashlib.sha256(b"7").hexdigest()
D = H.translate(str.maketrans("abcdef", "012345"))


def plant(name, third):
    """The planted text and value of one row, by evaluating its SQL with DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    from cloakframe.plans.plants import expression, planted_text

    key = 9 if third else 7
    c = duckdb.connect()
    c.sql(f"CREATE TABLE customer AS SELECT {key}::BIGINT AS c_custkey")
    text = c.sql(f"SELECT {planted_text(name, True)} FROM customer").fetchall()[0][0]
    return text, c.sql(f"SELECT {expression(PLANTS[name][1], True)} FROM customer").fetchall()[0][0]


def test_every_detector_has_a_plant():
    assert {d.name for d in DETECTORS} == set(PLANTS) and len(DETECTORS) == 43


def rewrite(text, **rules):
    """Text with the placeholders of its detections, and the mapping back."""
    dets = sorted(detect(text, **rules), key=lambda d: (d.start, d.start - d.end, d.order))
    upto, spans, back = 0, [], {}
    for d in dets:
        if d.start < upto:
            continue
        upto, tokens = d.end, []
        for real, entity in d.lookups:
            counted = {"ip_network": lambda: entities.network_slot(3), "ipv6_network": lambda: entities.network6_slot(3)}
            token = counted[entity]() if entity in counted else entities.placeholder(entity, real)
            back[token] = real
            tokens.append(token)
        spans.append((d.start, d.end, formats.replacement(d.kind, d.before, d.after, tokens)))
    return formats.splice(text, spans), back


@pytest.mark.parametrize("name", sorted(PLANTS))
def test_invariants(name):
    text, value = plant(name, False)
    off = frozenset(d.name for d in DETECTORS) - {name}
    found = [text[d.start : d.end] for d in detect(text, disabled=off)]
    assert found == [value]  # fires
    hidden, back = rewrite(text, disabled=off)
    assert value not in hidden
    assert rewrite(text, disabled=off)[0] == hidden  # stable
    assert not detect(hidden, disabled=off)  # idempotent
    if name not in ("contact.intl_phone", "india_pii.aadhaar"):
        assert formats.restore(hidden, back) == text  # there and back
    else:  # restored in the canonical form
        assert re.sub("[^0-9]", "", formats.restore(hidden, back)) == re.sub("[^0-9]", "", text)
    stays, _ = plant(name, True)
    assert not detect(stays, disabled=off)  # no false alarm
    assert not detect("the quick brown fox, v1.2.3 of 2024", disabled=off)


@pytest.mark.parametrize(
    ("text", "gone"),
    [
        ("mail.acmeco.co.uk", ["acmeco"]),
        ("acme-vpn.acme-co.com", ["acme-co", "acme-vpn"]),
        ("acmeco.okta.com", ["acmeco"]),
        ("acmeco.com.out.txt", ["acmeco"]),
        ("hdr_acmeco.com", ["acmeco"]),
        ("https://main.rs/", ["main"]),
        ("db01.corp.run(10.0.0.5)", ["corp", "10.0.0"]),
        ("éAKIA" + H[:16].upper(), [H[:16].upper()]),
    ],
)
def test_replaced(text, gone):
    hidden, _ = rewrite(text)
    assert all(g not in hidden for g in gone)


@pytest.mark.parametrize(
    "text",
    ["main.rs", "job.run(", "password = settings.DB_PASSWORD", f"sha256: {H}", "user@example.com", "127.0.0.1 ::1 192.0.2.7", "ff:ff:ff:ff:ff:ff", f'token = "{H[:40]}"', "4111111111111111", "http://host1/", "password: ${SECRET}"],
)
def test_stays(text):
    assert rewrite(text)[0] == text


def test_block_and_known_heads():
    assert [d.lookups[0][1] for d in detect("see ACME now", block=("(?i)acme",))] == ["custom_block"]
    assert [k for k, head in starts("see hunter22x, not xhunter22x") if head == "hunter"] == [4]


def test_a_detectors_error_is_not_caught():
    def broken(text):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        detect("x", extra=(broken,))


def test_numbers():
    assert numbers.verhoeff("2363") and not numbers.verhoeff("2364")
    assert [numbers.run_of_digits(x) for x in ("1111", "1234", "4321", "1235", "")] == [True, True, True, False, False]
    assert numbers.calling_code("919876512345") == ("91", "9876512345") and numbers.calling_code("1415") is None
    assert sorted(x for row in numbers.TIMES for x in row) == sorted(list(range(10)) * 10)


def test_hosts():
    assert hosts.split_host("a.b.co.uk") == ("a.", "b", "co.uk")
    assert hosts.split_host("x.acct.blob.core.windows.net") == ("x.", "acct", "blob.core.windows.net")
    assert hosts.split_host("a.nosuchtop") is None and hosts.split_host("com") is None
    assert hosts.registrable("www.acme.com") == ("acme.com", False) and hosts.registrable("x.example.org") is None


def test_network_slots():
    assert [entities.network_slot(n) for n in (0, 255, 256, 511)] == ["198.18.0", "198.18.255", "198.19.0", "198.19.255"]
    with pytest.raises(ValueError):
        entities.network_slot(512)
    assert entities.network_slot(512, extended=True) == "240.0.0"


@pytest.mark.parametrize("entity", sorted(entities.SHAPES))
def test_placeholders_are_found_again(entity):
    token = entities.placeholder(entity, "some value")
    assert re.fullmatch(entities.shape_pattern(entity), token)
    wire = {"domain": f"a.{token}.com", "email_local": f"{token}@x", "intl_phone": f"+44-{token}"}.get(entity, f"x {token} y")
    assert token in formats.candidates(wire)


@given(st.text(max_size=200))
def test_detect_and_restore_never_fail(text):
    hidden, back = rewrite(text)
    formats.restore(hidden, back)
    assert rewrite(text)[0] == hidden


def test_lists_of_suffixes_and_tops(tmp_path):
    """Rules that the driver installs are the ones in use, here and in what it ships."""
    (tmp_path / "suffixes").write_text("// a list\ncom\n*.ck\n!www.ck\nco.zz\nzz\n")
    (tmp_path / "tops").write_text("# tops\nCOM\nZZ\nODDTOP\n")
    before = hosts.suffix_rules()
    try:
        assert hosts.split_host("a.b.oddtop") is None
        hosts.install(hosts.read_suffixes(str(tmp_path / "suffixes"), str(tmp_path / "tops")))
        shipped = hosts.shipped(hosts.split_host)
        hosts.install(before)
        assert shipped("a.b.oddtop") == ("a.", "b", "oddtop") and shipped("x.acme.co.zz") == ("x.", "acme", "co.zz") and shipped("a.b.net") is None
    finally:
        hosts.install(before)


def test_small_marks_stand_in_every_small_placeholder():
    for entity in entities.SMALL:
        token = entities.placeholder(entity, "x")
        text = f"+44-{token}" if entity == "intl_phone" else token
        assert formats.standing(text) == [token] and any(m in text for m in formats.SMALL_MARKS)
