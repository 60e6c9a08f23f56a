"""Structured Streaming forms of ingest, admission and history."""
