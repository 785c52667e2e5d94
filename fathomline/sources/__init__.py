"""Readers of tables and of raw files."""
