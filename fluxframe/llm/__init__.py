"""Operators for preparing training text, all with Spark doing the distribution."""
