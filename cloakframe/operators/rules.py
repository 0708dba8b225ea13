"""Rules: which categories run, what operators block and allow. A JSON file, compiled once per batch."""

from __future__ import annotations

import contextlib
import copy
import json
import os
import re
import time
from dataclasses import dataclass, field

from ..functions import hosts
from ..functions.patterns import ALLOW_LISTS, DETECTORS
from .resolve import allow_pattern

CATALOGUE = {d.name: d.about for d in DETECTORS} | {f"allowlist.{k}": f"Hosts that stay readable: {k.replace('_', ' ')}" for k in ALLOW_LISTS}
ENGAGEMENT = re.compile(r"[A-Za-z0-9_-]{1,64}\Z")


@dataclass(frozen=True)
class Compiled:
    """Rules as the plan needs them."""

    disabled: frozenset = frozenset()
    block: tuple[str, ...] = ()
    allow: str | None = None
    forced: frozenset = frozenset()

    def off(self, name: str) -> bool:
        return name in self.disabled or name.partition(".")[0] in self.disabled


def check_engagement(name: str) -> str:
    if not ENGAGEMENT.match(name):
        raise ValueError(f"not an engagement's name: {name!r}")
    return name


@dataclass
class Rules:
    """The file's content. Entries are dicts: value, regex, note, is_domain."""

    categories: dict[str, dict] = field(default_factory=dict)
    block: list[dict] = field(default_factory=list)
    allow: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Rules:
        """A missing file is an empty one; a byte order mark is skipped."""
        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8-sig") as f:
            data = json.load(f)
        out = cls(data.get("categories") or {}, data.get("block") or [], data.get("allow") or [])
        out.validate()
        return out

    def save(self, path: str) -> None:
        """Readers see the old file or the new one, never a part."""
        own = f"{path}.{os.getpid()}"
        with open(os.open(own, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
            json.dump({"categories": self.categories, "block": self.block, "allow": self.allow}, f, indent=2, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, path)

    def validate(self, spark=None) -> None:
        """``spark``: patterns must compile on the executors' other engine, Java's, too."""
        for entry in [*self.block, *self.allow] if spark is not None else ():
            if entry.get("regex"):
                try:
                    spark.sparkContext._jvm.java.util.regex.Pattern.compile(entry["value"])
                except Exception as e:
                    raise ValueError(f"not a regular expression in Java: {entry['value']!r}") from e
        for entry in [*self.block, *self.allow]:
            value = entry.get("value", "")
            if not value.strip():
                raise ValueError("an entry without a value")
            if entry.get("regex"):
                try:
                    empty = re.compile(value).search("")
                except re.error as e:
                    raise ValueError(f"not a regular expression: {value!r}: {e}") from e
                if empty:
                    raise ValueError(f"matches the empty text: {value!r}")

    def reconcile(self) -> list[str]:
        """Adds categories that are new (enabled), refreshes descriptions, drops and returns those that are gone."""
        gone = sorted(set(self.categories) - set(CATALOGUE))
        for name in gone:
            del self.categories[name]
        for name, about in CATALOGUE.items():
            self.categories.setdefault(name, {"enabled": True})["description"] = about
        return gone

    def find(self, which: str, value: str) -> int | None:
        entries = getattr(self, which)
        return next((k for k, e in enumerate(entries) if e["value"].lower() == value.lower()), None)

    def add(self, which: str, value: str, regex: bool = False, note: str = "", is_domain: bool = False) -> bool:
        """False if the entry is there already; an entry of the other list is an error."""
        other = "allow" if which == "block" else "block"
        if self.find(other, value) is not None:
            raise ValueError(f"{value!r} is on the {other} list")
        if self.find(which, value) is not None:
            return False
        new = copy.deepcopy(self)
        getattr(new, which).append({"value": value, "regex": regex, "note": note, "is_domain": is_domain})
        new.validate()
        setattr(self, which, getattr(new, which))
        return True

    def remove(self, value: str) -> bool:
        hits = [(w, k) for w in ("block", "allow") if (k := self.find(w, value)) is not None]
        for which, k in hits:
            getattr(self, which).pop(k)
        return bool(hits)

    def toggle(self, name: str, enabled: bool) -> None:
        known = set(CATALOGUE) | {n.partition(".")[0] for n in CATALOGUE}
        if name not in known:
            raise ValueError(f"no such category: {name}")
        for n in CATALOGUE:
            if name in (n, n.partition(".")[0]):
                self.categories.setdefault(n, {"description": CATALOGUE[n]})["enabled"] = enabled

    def without(self, *names: str) -> Rules:
        """A copy for one run with categories off; it is never saved."""
        out = copy.deepcopy(self)
        for n in names:
            out.toggle(n, False)
        return out

    def shadowed(self) -> list[str]:
        """Block entries that an allow entry matches: they never act."""
        allow = self.compiled().allow
        return [e["value"] for e in self.block if allow and not e.get("regex") and re.match(allow.replace(r"\z", r"\Z"), e["value"])]

    def compiled(self) -> Compiled:
        self.validate()
        disabled = frozenset(n for n, c in self.categories.items() if c.get("enabled") is False)
        block = tuple(e["value"] if e.get("regex") else "(?i)" + re.escape(e["value"]) for e in self.block if not (e.get("is_domain") and hosts.registrable(e["value"])))
        forced = frozenset(f[0] for e in self.block if e.get("is_domain") and (f := hosts.registrable(e["value"])))
        listed = [h for k, v in ALLOW_LISTS.items() if f"allowlist.{k}" not in disabled for h in v]
        values = [e["value"] if e.get("regex") else re.escape(e["value"]) for e in self.allow]
        return Compiled(disabled, block, allow_pattern(values, listed), forced)


def blocked_paths(paths: list[str], rules: Compiled) -> list[str]:
    """Paths and table names in which a block pattern occurs: they would leak through plans and logs."""
    return [p for p in paths if any(re.search(b, p) for b in rules.block)]


@contextlib.contextmanager
def locked(path: str, wait: float = 5.0, step: float = 0.02):
    """One writer of a rules file at a time, by a lock file that only one can create."""
    name, until = f"{path}.lock", time.monotonic() + wait
    while True:
        try:
            os.close(os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            if time.monotonic() > until:
                raise TimeoutError(f"{name} is held") from None
            time.sleep(step)
    try:
        yield
    finally:
        os.unlink(name)


class Watcher:
    """The compiled rules of a file, read anew when it changes. A file that can't be read keeps the rules before it."""

    def __init__(self, path: str):
        self.path, self.seen, self.error = path, None, None
        self.current = Rules().compiled()
        self.check()

    def check(self) -> Compiled:
        stamp = os.stat(self.path).st_mtime_ns if os.path.exists(self.path) else 0
        if stamp != self.seen or self.error:
            try:
                self.current, self.error = Rules.load(self.path).compiled(), None
            except (ValueError, OSError) as e:
                self.error = str(e)
            self.seen = stamp
        return self.current
