"""All detectors on one text, in Python: what the Arrow UDF runs. Offsets are code points.

A detection is (start, end, order, lookups, kind, before, after, keep): ``lookups`` are (real value, entity); ``kind`` says
how the placeholders become the replacement (``functions.formats``); ``keep`` marks a host in a path, which is replaced
only if its value is known otherwise. An error in a detector is never caught here: the row must not come out unredacted.
"""

from __future__ import annotations

import base64
import binascii
import functools
import ipaddress
import unicodedata
from typing import NamedTuple

import regex

from . import hosts
from .numbers import intl_phone, run_of_digits, verhoeff
from .patterns import DETECTORS, HOLDER_CODES, NEAR, NO_PASSWORDS, PATTERNS, VENDOR_PATTERNS

ASCII_CLASSES = regex.ASCII
JWT_MARK, BEARER_MARK = "eyJredacted", "tok-bearer-"


class Detection(NamedTuple):
    start: int
    end: int
    order: int
    lookups: tuple[tuple[str, str], ...]
    kind: str = "whole"
    before: str = ""
    after: str = ""
    keep: bool = False


@functools.cache
def compiled(pattern: str):
    return regex.compile(pattern, 0 if "\\p{" in pattern else ASCII_CLASSES)


@functools.cache
def named(name: str):
    """A pattern by name. Where it holds Unicode classes, its word edges are spelt out to stay ASCII."""
    p = PATTERNS[name]
    if "\\p{" in p:
        p = p.replace(r"\b", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")
    return compiled(p)


PATTERN_OF = {d.name: d.pattern for d in DETECTORS}


def visible(text: str) -> tuple[str, list[int] | None]:
    """The text without format characters and marks, and the place of each remaining character; None if nothing goes."""
    if text.isascii():
        return text, None
    places = [i for i, c in enumerate(text) if unicodedata.category(c) not in ("Cf", "Mn")]
    if len(places) == len(text):
        return text, None
    return "".join(text[i] for i in places), places


def place(places: list[int] | None, k: int, end: bool = False) -> int:
    if places is None:
        return k
    return places[k - 1] + 1 if end else places[k]


def email(text: str):
    clean, places = visible(text)
    for m in named("email").finditer(clean):
        local, _, host = m[0].lower().rpartition("@")
        if regex.fullmatch("user-[0-9a-f]{12}", local) or hosts.own(host) or m[0].startswith("ATBB") or hosts.reserved(host):
            continue
        if not (parts := hosts.split_host(host)):
            continue
        labels = f"{parts[1]}.{parts[2]}".count(".") + 1
        start, end = place(places, m.start()), place(places, m.end(), True)
        own = hosts.last_labels(m[0].rpartition("@")[2], labels)
        real = text[place(places, m.end() - len(own)) : end].lower()
        before = "" if hosts.leaks(parts[0], parts[1]) else parts[0]
        yield start, end, ((text[start:end].lower(), "email_local"), (real, "domain")), "email", before, parts[2], False


def domain(text: str, forced: frozenset = frozenset()):
    clean, places = visible(text)
    for m in named("domain").finditer(clean):
        name = m[1]
        if hosts.own(name.lower()):
            continue
        at, tried, parts = m.start(1), name, None
        while tried:
            if not hosts.reserved(tried.lower()) and (parts := hosts.split_host(tried.lower())):
                break
            tried = tried.rpartition(".")[0]
        start, whole = place(places, at), place(places, at + len(name), True)
        keep = hosts.in_path(text, start)
        if parts:
            end = place(places, at + len(tried), True)
            own = hosts.last_labels(tried, f"{parts[1]}.{parts[2]}".count(".") + 1)
            real = text[place(places, at + len(tried) - len(own)) : end].lower()
            if real not in forced and (hosts.file_name(text, start, end, parts[0], parts[2]) or hosts.method_call(text, start, whole, parts[2])):
                continue
            before = "" if hosts.leaks(parts[0], parts[1]) else parts[0]
            yield start, end, ((real, "domain"),), "domain", before, parts[2], keep
        elif hit := next((f for f in sorted(forced) if name.lower() == f or name.lower().endswith("." + f)), None):
            yield start, whole, ((hit, "domain"),), "forced", name.lower()[: -len(hit)], "", keep


def internal_host(text: str):
    for pattern in ("url_host", "port_host"):
        for m in named(pattern).finditer(text):
            own, label = m[1], m[1].lower()
            if not any(c.isdigit() for c in label) or hosts.OWN_LABEL.match(label) or label.startswith("redacted-creds-"):
                continue
            if own not in (label, own.upper()) or compiled(PATTERNS["sample_host"]).match(label):
                continue
            yield m.start(1), m.end(1), ((label, "domain"),), "whole", "", "", False


def ipv4(text: str):
    for m in named("ipv4").finditer(text):
        a, b, c, d = (int(x) for x in m[0].split("."))
        if any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
            continue
        made = (a == 198 and b in (18, 19)) or a == 240
        if made or a == 127 or (a, b, c) in ((192, 0, 2), (198, 51, 100), (203, 0, 113)):
            continue
        yield m.start(), m.end(), ((f"{a}.{b}.{c}", "ip_network"),), "ipv4", "", str(d), False


def ipv6(text: str):
    for m in named("ipv6").finditer(text):
        v = m[0]
        if v.count(":") < 2 or len(v) - v.count(":") < 4 or v.lower().startswith("fd00:c0de:"):
            continue
        try:
            address = ipaddress.IPv6Address(v)
        except ValueError:
            continue
        if address.is_loopback or address in ipaddress.IPv6Network("2001:db8::/32"):
            continue
        bits = address.packed.hex()
        yield m.start(), m.end(), ((bits[:16], "ipv6_network"),), "ipv6", "", ":".join(bits[k : k + 4] for k in range(16, 32, 4)), False


def mac(text: str):
    for m in compiled(PATTERN_OF["network.mac"]).finditer(text):
        v = m[0].lower()
        if v not in ("ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00") and not v.startswith("02:00:00:"):
            yield m.start(), m.end(), ((v, "mac"),)


def phone(text: str):
    for m in compiled(PATTERN_OF["contact.phone"]).finditer(text):
        if "555-01" not in m[0].replace(".", "-").replace(" ", "-"):
            yield m.start(), m.end(), ((m[0], "phone"),)


def other_phone(text: str):
    for m in compiled(PATTERN_OF["contact.intl_phone"]).finditer(text):
        if not regex.fullmatch(r"\+[0-9]{1,3}-555-[0-9]{4}", m[0]) and (found := intl_phone(m[0])):
            yield m.start(), m.end(), (("+" + "".join(found), "intl_phone"),), "intl", found[0], "", False


def basic_credential(value: str) -> bool:
    """Whether base64 text is printable UTF-8 with a colon."""
    body = value.rstrip("=")
    try:
        plain = base64.b64decode(body + "=" * (-len(body) % 4), validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        return False
    return len(body) % 4 != 1 and ":" in plain and all(c.isprintable() for c in plain)


def bearer(text: str):
    anchored = {m.span(1) for m in named("aws_secret").finditer(text)}
    found = [m for m in named("bearer").finditer(text)]
    found += [m for m in named("basic").finditer(text) if basic_credential(m[1])]
    found += [m for m in named("credential").finditer(text) if any(c in "0123456789" for c in m[1])]
    for m in found:
        v = m[1]
        if v.startswith((BEARER_MARK, JWT_MARK)) or compiled(PATTERN_OF["secrets.jwt"]).search(v) or named("aws_id").search(v):
            continue
        if regex.fullmatch("[A-Za-z0-9/+]{40}", v) and m.span(1) in anchored:
            continue
        yield m.start(1), m.end(1), ((v, "bearer_token"),)


def connection(text: str):
    for m in named("conn_url").finditer(text):
        if "REDACTED-CREDS-" not in m[1]:
            yield m.start(1), m.end(1), ((m[1], "conn_string"),)
    for m in named("conn_password").finditer(text):
        near = text[max(0, m.start(1) - NEAR) : m.end(1) + NEAR]
        if "REDACTED-CREDS-" not in m[1] and named("conn_near").search(near):
            yield m.start(1), m.end(1), ((m[1], "conn_string"),)


def signed(text: str):
    for m in compiled(PATTERN_OF["secrets.itsdangerous_token"]).finditer(text):
        if not m[1].startswith(("tok-signed-", JWT_MARK)) and not compiled(PATTERN_OF["secrets.jwt"]).search(m[1]):
            yield m.start(1), m.end(1), ((m[1], "itsdangerous_token"),)


def password_end(text: str, at: int) -> tuple[int, int, bool] | None:
    """(start, end, quoted) of the value at a place: up to the same quote on the line, or to a delimiter."""
    if at >= len(text):
        return None
    quote = text[at]
    if quote in "\"'`":
        end = at + 1
        while end < len(text) and text[end] not in (quote, "\n"):
            end += 2 if text[end] == "\\" and end + 1 < len(text) else 1
        return (at + 1, end, True) if text[end : end + 1] == quote else None
    m = compiled(r"[^ \t\r\n\"'`,;&)}\]<>]*").match(text, at)
    return at, m.end(), False


def no_password(value: str, quoted: bool) -> bool:
    """Whether a value is a word, a placeholder, a template, a path, or code rather than a password."""
    if not 4 <= len(value) <= 200 or value.startswith("FAKE-PASSWORD-") or value.lower() in NO_PASSWORDS or len(set(value)) == 1:
        return True
    if any(x in value for x in ("${", "{{", "%(", "$(")) or value.startswith(("$", "/", "~/", "./", "../")):
        return True
    if (value[0], value[-1]) in (("%", "%"), ("<", ">")):
        return True
    return not quoted and (bool(regex.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)*", value)) or any(c in value for c in "([{"))


def password(text: str):
    for m in named("password_label").finditer(text):
        if (found := password_end(text, m.end())) and not no_password(text[found[0] : found[1]], found[2]):
            yield found[0], found[1], ((text[found[0] : found[1]], "password"),)


def password_hash(text: str):
    spans = [m.span(1) for m in named("hash").finditer(text)]
    spans += [m.span(k) for m in named("hash_pair").finditer(text) for k in (1, 2)]
    for s, e in spans:
        if not text.startswith("FAKEHASH", s):
            yield s, e, ((text[s:e], "password_hash"),)


def aadhaar(text: str):
    for m in compiled(PATTERN_OF["india_pii.aadhaar"]).finditer(text):
        d = m[0].replace(" ", "")
        if not d.startswith("0000") and not run_of_digits(d) and verhoeff(d):
            yield m.start(), m.end(), ((f"{d[:4]} {d[4:8]} {d[8:]}", "aadhaar"),)


def pan(text: str):
    for m in compiled(PATTERN_OF["india_pii.pan"]).finditer(text):
        if not m[0].startswith("FAKEP") and m[0][3] in HOLDER_CODES:
            yield m.start(), m.end(), ((m[0], "pan"),)


def aws(text: str):
    for m in named("aws_id").finditer(text):
        if not m[0].startswith("AKIAFAKE"):
            yield m.start(), m.end(), ((m[0], "aws_key"),)
    for m in named("aws_secret").finditer(text):
        if not m[1].startswith("tok-aws-secret-"):
            yield m.start(1), m.end(1), ((m[1], "aws_secret_key"),)


def vendors(text: str):
    for p in VENDOR_PATTERNS:
        for m in compiled(p).finditer(text):
            group = 1 if compiled(p).groups else 0
            if BEARER_MARK not in m[group]:
                yield m.start(group), m.end(group), ((m[group], "bearer_token"),)


PROCEDURES = {
    "contact.email": email,
    "network.domain": domain,
    "network.internal_host": internal_host,
    "network.ipv4": ipv4,
    "network.ipv6": ipv6,
    "network.mac": mac,
    "contact.phone": phone,
    "contact.intl_phone": other_phone,
    "secrets.bearer_token": bearer,
    "secrets.connection_string": connection,
    "secrets.itsdangerous_token": signed,
    "secrets.password": password,
    "secrets.password_hash": password_hash,
    "india_pii.aadhaar": aadhaar,
    "india_pii.pan": pan,
    "cloud.aws": aws,
    "secrets.vendor_keys": vendors,
}


def plain(detector, text: str):
    """Detectors that are a pattern and a mark."""
    group = int(detector.capture)
    for m in compiled(detector.pattern).finditer(text):
        if detector.mark not in m[group] or not detector.mark:
            yield m.start(group), m.end(group), ((m[group], detector.entity),)


def blocked(text: str, patterns: tuple[str, ...]):
    """Operators' own patterns. They aren't trusted to end soon, so each has a time limit, and running out is an error."""
    for p in patterns:
        for m in regex.compile(p).finditer(text, timeout=10):
            if m[0] and not m[0].startswith("tok-blocked-"):
                yield m.start(), m.end(), ((m[0], "custom_block"),)


KNOWN_LENGTH = 6


def starts(text: str):
    """(place, characters from there) of every place at which a stored value could begin to stand alone."""
    for k in range(len(text) - KNOWN_LENGTH + 1):
        if not (text[k].isalnum() and k and text[k - 1].isalnum()):
            yield k, text[k : k + KNOWN_LENGTH]


def eligible(value: str) -> bool:
    """Whether a stored value is distinctive enough to be searched for without its label."""
    kinds = {"l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in value}
    return len(value) >= KNOWN_LENGTH and len(kinds) >= 2 and not set(value) & set("\n\r")


def detect(text: str, disabled: frozenset = frozenset(), forced: frozenset = frozenset(), block: tuple[str, ...] = (), extra: tuple = (), mask: int = -1) -> list[Detection]:
    """All detections, in the order of the catalogue, then block patterns, then registered detectors. ``mask``: a bit for
    each detector of the catalogue that can find something."""
    out: list[Detection] = []
    low = text.lower()
    for order, d in enumerate(DETECTORS):
        if not mask >> order & 1 or d.name in disabled or d.name.partition(".")[0] in disabled or (d.literals and not any(x in low for x in d.literals)):
            continue
        procedure = PROCEDURES.get(d.name)
        found = procedure(text, forced) if procedure is domain else procedure(text) if procedure else plain(d, text)
        out += [Detection(x[0], x[1], order, *x[2:]) for x in found]
    more = [blocked(text, block), *(f(text) for f in extra)]
    return out + [Detection(x[0], x[1], len(DETECTORS) + k, *x[2:]) for k, found in enumerate(more) for x in found]
