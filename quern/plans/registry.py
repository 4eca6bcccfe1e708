"""All queries of the reference's own operators, and their SQL."""

from __future__ import annotations

from quern.plans import chunk_plans, contract_plans, retrieval_plans, stats_plans, text_plans

_ALL = (text_plans, retrieval_plans, chunk_plans, contract_plans, stats_plans)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL = {k: s for m in _ALL for k, s in m.SQL.items()}
