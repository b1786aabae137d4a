"""Structured Streaming: apply fitted tables to arriving rows (stream-static joins)."""

from scorelens.streaming.monitor import band_counts_stream, run_available  # noqa: F401
