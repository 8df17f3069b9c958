"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from . import files, gates, jobs, metrics, pixels  # noqa: F401  (registration by import)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
