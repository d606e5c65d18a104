"""Imports every query module so that the registry is complete."""

from . import (blend_queries, filter_queries, ml_queries, neighbor_queries, run_queries, source_queries,  # noqa: F401
               stream_queries, telemetry_queries)  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
