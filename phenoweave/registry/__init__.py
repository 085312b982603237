"""Registered queries: each operator over the given tables, with its oracle SQL."""

from __future__ import annotations

from phenoweave.registry import (  # noqa: F401
    colour_queries,
    catalog_queries,
    detection_queries,
    embedding_queries,
    genetics_queries,
    mask_queries,
    recon_queries,
    split_queries,
    trainlog_queries,
)
from phenoweave.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
