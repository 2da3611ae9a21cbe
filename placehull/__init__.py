"""Match named points to area outlines with Spark DataFrames."""

from placehull.options import PRESETS, MatchOptions

__all__ = ["MatchOptions", "PRESETS"]
