"""Operators on tables: catalog, foreign keys, search, and writes to document folders."""
