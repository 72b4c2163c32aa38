from xrel.plans import (  # noqa: F401
    assemble_queries,
    edge_queries,
    entity_queries,
    maintain_queries,
    pattern_queries,
    projection_queries,
    route_queries,
)
from xrel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
