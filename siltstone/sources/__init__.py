"""Readers, writers and parsers for external layouts."""
