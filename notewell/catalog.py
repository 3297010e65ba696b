"""Registered queries over the driver's tables and the DuckDB SQL of each."""

from __future__ import annotations

from notewell.plans import jobs as _jobs  # noqa: F401  registers them
from notewell.plans import queries as _queries  # noqa: F401  registers them
from notewell.plans import records as _records  # noqa: F401  registers them
from notewell.plans import transitions as _transitions  # noqa: F401  registers them
from notewell.plans import upkeep as _upkeep  # noqa: F401  registers them
from notewell.plans.registry import ORACLES, QUERIES

FLAGSHIP = "bm25_search"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
