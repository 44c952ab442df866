"""gridloom: deterministic, population-balanced partitioning of spatial grids on Spark, and training-data operators."""

from .storage import attach

__all__ = ["attach"]
