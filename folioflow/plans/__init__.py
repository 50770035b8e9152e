"""Registered queries and their oracles."""

from . import billing, documents
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "billing", "documents"]
