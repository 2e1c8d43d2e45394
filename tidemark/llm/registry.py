"""Queries and SQL of the subpackage."""

from tidemark.llm import contamination, formatting_duplicates, frequency, nearest_time, pii, runs, tokens, vectors

_ALL = (frequency, vectors, runs, nearest_time, formatting_duplicates, tokens, contamination, pii)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL = {k: v for m in _ALL for k, v in m.SQL.items()}
