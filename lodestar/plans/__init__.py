"""Queries over the driver's tables, each with SQL that gives the same rows where SQL can express it."""

from lodestar.plans import curation, gates, language, machines, reviews, star, streams, vision
from lodestar.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "curation", "gates", "language", "machines", "reviews", "star", "streams", "vision"]
