"""All queries of the engine and, for each that SQL can express, the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from .plans import geometry, journal, multihazard, oracles, records  # noqa: F401  (modules of queries register them)
from .plans.catalogue import FLAGSHIP, QUERIES
from .plans.studies import STUDIES

ORACLES = oracles.ORACLES | STUDIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
