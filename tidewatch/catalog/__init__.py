"""Registered queries by family."""

from tidewatch.catalog import chatting, running, shaping, snapshots, streams, watching  # noqa: F401
from tidewatch.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
