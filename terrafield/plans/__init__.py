"""Fixture views over the given tables, and the registered queries with their SQL twins."""
