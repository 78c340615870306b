"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import scoring, tables

QUERIES = scoring.QUERIES | tables.QUERIES
ORACLES = scoring.ORACLES | tables.ORACLES
