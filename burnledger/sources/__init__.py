"""Schemas, readers, writers and the bridge from the test tables."""
