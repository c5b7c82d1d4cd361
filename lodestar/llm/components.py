"""Connected components of links."""

from lodestar.operators.duplicates import linked as components

__all__ = ["components"]
