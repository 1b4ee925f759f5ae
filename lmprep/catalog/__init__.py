"""Queries over the driver tables, one per operator, with the SQL they must equal."""

from lmprep.catalog import score_queries, text_queries, token_queries  # noqa: F401
from lmprep.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
