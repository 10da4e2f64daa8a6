"""Structured Streaming versions of the rollups, statistics, de-duplication and scoring."""
