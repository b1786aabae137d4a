"""Reusable plan fragments: exact distributed ordering, size-checked broadcast."""
