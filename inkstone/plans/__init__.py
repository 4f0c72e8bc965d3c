"""Registered queries."""

from . import check_queries, document_queries, editorial_queries, extract_queries, finding_queries, layout_queries, lifecycle_queries, ranking_queries, source_queries, state_queries, text_queries  # noqa: F401
