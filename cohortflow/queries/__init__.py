"""Registered queries and the DuckDB text each is checked against."""
