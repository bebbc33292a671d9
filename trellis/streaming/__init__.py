"""Streams into the store."""

from .ingest import ingest_stream, ops_stream

__all__ = ["ingest_stream", "ops_stream"]
