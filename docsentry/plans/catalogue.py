"""Imports every query module so the registry is complete."""

from . import findings_queries, io_queries, markdown_queries, ml_queries, monitor_queries, scoring_queries, secrets_queries, structure_queries, temporal_queries  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES  # noqa: F401
