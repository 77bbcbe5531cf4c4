"""Readers of tables, logs, feeds and files."""
