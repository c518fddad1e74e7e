"""Incremental ingestion of recorded files."""
