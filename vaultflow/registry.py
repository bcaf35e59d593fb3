"""Registered queries of the knowledge-base operators and their SQL."""

from .plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
