"""Queries by operator id. Importing the package registers them."""

from catalog import documents, evidence, metrics, pages, programs, retrieval, rewards, sources, text  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
