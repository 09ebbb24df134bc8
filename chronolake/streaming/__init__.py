"""Structured Streaming: ingest into a store and a running latest view."""
