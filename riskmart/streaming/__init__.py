"""Streaming ingestion of raw feeds."""
