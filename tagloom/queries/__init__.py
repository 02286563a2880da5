"""The operators applied to the test tables, with equivalent SQL where there is one."""

from tagloom.queries import (  # noqa: F401  (importing a module registers its queries)
    aggregates,
    cleaning,
    features,
    functions,
    joins,
    learned,
    models,
    sampling,
    sources,
    workflows,
)
from tagloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
