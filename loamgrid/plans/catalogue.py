"""Registry of the analytics queries and their SQL twins."""

from __future__ import annotations

from loamgrid.plans import expression_queries, page_queries, record_queries, report_queries, review_queries, run_queries, source_queries, table_queries

_ALL = (table_queries, expression_queries, run_queries, review_queries, report_queries, source_queries, page_queries, record_queries)
QUERIES = {k: v for m in _ALL for k, v in m.here.queries.items()}
ORACLES = {k: v for m in _ALL for k, v in m.here.oracles.items()}
FLAGSHIP = "dq_flags"
