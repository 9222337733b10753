"""Operators for preparing text corpora. Nothing outside this folder imports it."""

from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
