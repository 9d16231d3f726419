"""Registered queries, one module per part of the engine."""

from storyloom.plans import feed, identity, ingest, labels, readers, scalars, similarity, sources, streaming  # noqa: F401
from storyloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
