"""Readers, writers and parsers of the input formats."""
