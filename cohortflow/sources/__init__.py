"""Readers, writers, lookups and stand-in tables."""
