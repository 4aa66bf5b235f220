"""Readers, parsers and merges."""
