"""inkwell: document search and text analytics as Spark DataFrame plans."""

from inkwell.model import SearchOptions, SortOrder

__all__ = ["SearchOptions", "SortOrder"]
