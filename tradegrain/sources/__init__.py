"""Readers that turn files into one table set (:class:`MarketTables`)."""

from tradegrain.sources.market import Market, MarketTables

__all__ = ["Market", "MarketTables"]
