"""All registered queries of the engine outside quillon.llm, with their SQL."""

from __future__ import annotations

from quillon.plans import experiments, filings, knowledge, outcomes, relational, research, series, services, stream

_MODULES = (series, relational, research, knowledge, stream, outcomes, services, filings, experiments)

FLAGSHIP = "win05_12_bar_features"
QUERIES: dict = {name: f for module in _MODULES for name, f in module.Q.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
