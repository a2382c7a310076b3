"""Queries over the given tables, each with the SQL that must give the same result."""

from __future__ import annotations

from . import cleaning, encoding, estimation, filling, fits, geography, joining, plots, quality, summarising
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "encoding", "estimation", "filling", "fits", "geography", "joining", "plots",
           "quality", "summarising"]
