"""Readers, writers, schemas and fixed tables."""
