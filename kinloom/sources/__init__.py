"""Readers, writers and the record view over the driver's tables."""
