"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames, reads only the
columns it names and ignores others, so extra columns never clash with its own.
"""
