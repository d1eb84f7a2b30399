"""Readers."""

from tidewell.sources.tables import first_deliveries, table

__all__ = ["first_deliveries", "table"]
