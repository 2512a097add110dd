"""Structured Streaming into tables of the engine."""
