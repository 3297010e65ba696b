"""Registered queries of the training-data operators and the DuckDB SQL of those that have one."""

from __future__ import annotations

from notewell.llm import oracles, queries

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op") and name[2:3].isdigit()}
ORACLES = {name: getattr(oracles, name.upper()) for name in QUERIES if hasattr(oracles, name.upper())}
