"""Imports every query module so that the registry is complete."""

from . import campaigns, consensus, grouped_queries, io_queries, pixel_queries, rule_queries, scalars, series_queries, stream_queries, track_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
