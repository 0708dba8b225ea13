"""Scalar functions: entities and their placeholders, host names, numbers, text."""
