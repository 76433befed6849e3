"""Queries over the shared tables and their SQL twins."""

from importlib import import_module

from .base import QUERIES, SQL

for _name in ("series", "cycles", "events", "filings", "texts", "tables"):
    import_module(f".{_name}", __name__)

__all__ = ["QUERIES", "SQL"]
