"""All registered queries of the library, training-data operators aside."""

from mnemospark.plans import extract_queries, index_queries, profile_queries, search_queries, session_queries, stream_queries, transcript_queries  # noqa: F401
from mnemospark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
