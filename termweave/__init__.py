"""termweave: harmonising messy tabular metadata with Spark DataFrames."""

from .session import ship

__all__ = ["ship"]
