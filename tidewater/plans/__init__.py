"""Registered queries over the driver's tables and the SQL they are checked against."""

from . import alignment, bars, curves, flow, forecast, learning, pairs, pillars, portfolio, spectra, streams, text, triggers, walk  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
