"""Readers of tables, packet streams and recordings."""
