"""Relational operators: detect, resolve, vault, assemble, restore, JSON bodies."""
