"""Query plans over the driver tables."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from lattice.plans.workload import Query


def registered() -> dict[str, Query]:
    """All queries of the engine by name."""
    from lattice.plans import code_queries, cypher_queries, stored, workload

    return workload.QUERIES | code_queries.QUERIES | cypher_queries.QUERIES | stored.QUERIES
