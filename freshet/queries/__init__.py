"""Registered queries: each operator on inputs derived from the given tables, with its SQL twin."""

from . import areas, calendars, catalogue, geography, loads, readings, series, streams, tables, whole_rows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
