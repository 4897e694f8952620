"""All queries of the reference's own operators with their oracle SQL."""

from __future__ import annotations

from . import document_queries, extraction_queries, job_queries, label_queries, reply_queries, report_queries, review_queries  # all add to the last one's tables

assert document_queries.query is extraction_queries.query is job_queries.query is label_queries.query is reply_queries.query is report_queries.query is review_queries.query
QUERIES: dict = dict(report_queries.QUERIES)
ORACLE: dict[str, str] = dict(report_queries.ORACLE)
