"""Column-level functions (built-in expressions only, no Python UDFs)."""

from scorelens.functions.bands import band_labels, score_band  # noqa: F401
