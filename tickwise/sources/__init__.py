"""Readers, writers and the test views over the driver tables."""
