"""Imports every module that registers queries, so that the registry is complete."""

from __future__ import annotations

from plaza.plans import flatten_queries, more_queries, opinion_queries, record_queries, semantic_queries, stream_queries, word_queries
from plaza.plans.registry import oracles, queries

__all__ = ["flatten_queries", "more_queries", "opinion_queries", "record_queries", "semantic_queries", "stream_queries", "word_queries", "oracles", "queries"]
