"""All queries over the standard tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from plumbline.plans import checks, decisions, graphs, matching, relational, sequences
from plumbline.plans._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checks", "decisions", "graphs", "matching", "relational", "sequences"]
