"""Registered queries with their SQL twins, and the whole session job."""
