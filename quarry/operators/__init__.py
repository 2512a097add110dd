"""Operators on tables: writes, search, ingestion."""
