"""Readers, writers and the schema normaliser."""
