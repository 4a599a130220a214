"""Registered queries of the reference-parity operators and their SQL."""

from __future__ import annotations

from tesserae.queries import evaluations, relations, rulings, search, stored, texts, wording  # noqa: F401
from tesserae.queries.base import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
FLAGSHIP = QUERIES[search.bm25_or_topk.__name__]
