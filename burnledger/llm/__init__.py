"""Operators of a training-data pipeline over a table of documents.

Every operator takes a DataFrame with an id and a text column (names are parameters), ignores other columns, and
returns its own columns. Nothing outside this package imports it.
"""
