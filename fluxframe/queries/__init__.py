"""The query catalogue; importing a module registers its queries."""

from fluxframe.queries import q_layout, q_metrics, q_samples, q_shapes, q_spatial, q_tables, q_values  # noqa: F401
from fluxframe.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
