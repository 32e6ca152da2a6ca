"""Imports the query modules of this subpackage, so that the registry is complete."""

from . import page_queries, record_queries, text_queries, training_queries, vector_queries  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
