import os

import pytest

from cloakframe.operators.rules import CATALOGUE, Rules, Watcher, blocked_paths, check_engagement, locked


def test_load_save(tmp_path):
    path = str(tmp_path / "rules.json")
    assert Rules.load(path) == Rules()
    rules = Rules(block=[{"value": "acme"}])
    rules.save(path)
    assert Rules.load(path).block == rules.block and os.stat(path).st_mode & 0o777 == 0o600
    with open(path, "w", encoding="utf-8") as f:
        f.write('﻿{"allow": [{"value": "a"}]}')
    assert Rules.load(path).allow == [{"value": "a"}]


@pytest.mark.parametrize("entry", [{"value": " "}, {"value": "(", "regex": True}, {"value": "a*", "regex": True}])
def test_bad_entries(entry):
    with pytest.raises(ValueError):
        Rules(block=[entry]).validate()


def test_edit():
    rules = Rules(categories={"gone.one": {"enabled": False}})
    assert rules.reconcile() == ["gone.one"] and set(rules.categories) == set(CATALOGUE)
    assert rules.add("block", "acme") and not rules.add("block", "ACME")
    with pytest.raises(ValueError):
        rules.add("allow", "Acme")
    rules.toggle("network", False)
    assert rules.compiled().off("network.ipv4") and not rules.without("vcs.github").compiled().off("vcs.gitlab")
    assert rules.remove("aCME") and not rules.remove("acme")
    rules.add("block", "x.github.com")
    assert rules.shadowed() == ["x.github.com"]
    assert Rules(block=[{"value": "Build.Acme.com", "is_domain": True}]).compiled().forced == {"acme.com"}
    assert blocked_paths(["/data/AcmeCo", "/data/x"], Rules(block=[{"value": "acme"}]).compiled()) == ["/data/AcmeCo"]


def test_watcher_keeps_the_last_good_rules(tmp_path):
    path = tmp_path / "rules.json"
    Rules(block=[{"value": "one"}]).save(str(path))
    w = Watcher(str(path))
    path.write_text("{")
    os.utime(path, ns=(1, 1))
    assert w.check().block == ("(?i)one",) and w.error
    Rules(block=[{"value": "two"}]).save(str(path))
    assert w.check().block == ("(?i)two",) and not w.error


def test_lock(tmp_path):
    path = str(tmp_path / "rules.json")
    with locked(path), pytest.raises(TimeoutError), locked(path, wait=0.1):
        pass
    with locked(path):
        pass


@pytest.mark.parametrize("name", ["", "a b", "a/b", "x" * 65, "a\n"])
def test_engagement_names(name):
    with pytest.raises(ValueError):
        check_engagement(name)
