"""What operators do by hand, for any client: list, show and remove placeholders, list and change rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import Rules, locked
from .vault import Vault


def tokens(vault: Vault, entity: str | None = None, holding: str = "") -> DataFrame:
    """(token, entity_type, real, first_seen) of what restores, of one entity or all, with a text in the value or placeholder."""
    rows = vault.entries().select("token", "entity_type", "real", "first_seen")
    if entity is not None:
        rows = rows.where(F.col("entity_type") == entity)
    if holding:
        low = F.lit(holding.lower())
        rows = rows.where(F.contains(F.lower("real"), low) | F.contains(F.lower("token"), low))
    return rows


def show(vault: Vault, name: str) -> dict | None:
    """The entry of a value or placeholder, or None."""
    row = vault.entries().where((F.col("real") == name) | (F.col("token") == name)).first()
    return row.asDict() if row else None


def remove(vault: Vault, names: list[str]) -> list[str]:
    """Removes the entries of values or placeholders; returns the values that went."""
    gone = vault.entries().where(F.col("real").isin(names) | F.col("token").isin(names)).select("real")
    values = sorted(r["real"] for r in gone.collect())  # as many as were named, at most twice
    if values:
        vault.remove(vault.spark.createDataFrame([(v,) for v in values], "real string"))
    return values


def rules_listed(path: str) -> list[tuple[str, str, bool]]:
    """(list, value, whether it is a pattern) of all entries of a rules file."""
    rules = Rules.load(path)
    return [(which, e["value"], bool(e.get("regex"))) for which in ("block", "allow") for e in getattr(rules, which)]


def change_rules(path: str, change) -> object:
    """Applies ``change(rules)`` to a rules file under its lock and saves it; returns what ``change`` returned."""
    with locked(path):
        rules = Rules.load(path)
        done = change(rules)
        rules.validate()
        rules.save(path)
    return done
