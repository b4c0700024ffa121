"""The query catalogue: name to Spark callable, and name to equivalent SQL."""

from __future__ import annotations

from .operators import connect, graph, ingest, joins, kept, keyed, names, ontology, paths, positions, provenance, resolve, retrieval, simulate, world, worlds  # noqa: F401  they register their queries
from .plans import registry
from .sources import given  # noqa: F401
from .streaming import events, turns  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
