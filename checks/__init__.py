"""Queries over the given tables, with the same question as SQL for each."""
