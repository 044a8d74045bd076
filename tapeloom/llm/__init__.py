"""Operators of a training-data pipeline: whole-table jobs on documents and pages.

Nothing outside this folder imports it.  Every operator takes DataFrames, keeps
its own general interface, and has one thin registered query in ``catalog``.
"""
