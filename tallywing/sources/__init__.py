"""Readers, writers and the transaction frame built from the driver tables."""
