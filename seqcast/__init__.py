"""Forecasting on panels of daily bars, expressed as Spark jobs."""

from seqcast.config import Settings

__all__ = ["Settings"]
