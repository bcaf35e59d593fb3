"""Registered queries: views over the given tables, and SQL for each."""
