"""Spark-native operators for entity-keyed environmental time series."""

from fluxframe.session import build_session

__all__ = ["build_session"]
