"""Queries that bind the operators to tables, with their SQL, and whole pipelines."""
