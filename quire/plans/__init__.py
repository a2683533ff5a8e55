"""The library's queries by name, and their SQL."""

from __future__ import annotations

from .queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
