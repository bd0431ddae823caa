"""Registered queries of the library's own operators and the SQL that checks them."""

from __future__ import annotations

from .plans import alignment, cleaning, digests, metrics, sources, text  # noqa: F401 (they register)
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
