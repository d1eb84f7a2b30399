"""Structured Streaming: ingest of event tables, windows, keyed state."""

from tidewell.streaming.ingest import crossings, daily_counts, ingest

__all__ = ["crossings", "daily_counts", "ingest"]
