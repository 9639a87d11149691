"""Every operator as a query over the driver tables."""

from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
from . import audio_queries, capability_queries, clip_queries, index_queries  # noqa: E402,F401  registration
from . import playout_queries, session_queries, stream_queries, timing_queries  # noqa: E402,F401
