"""All queries of the engine; importing the modules registers theirs."""

from __future__ import annotations

from . import books, finding, market, papers, records  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
