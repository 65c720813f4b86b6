"""All queries of the telemetry engine, registered by importing their modules."""

from . import core_queries, evaluation_queries, evidence_queries, model_queries, more_queries, network_queries, read_queries, state_queries, stored_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
