"""Queries by name, with SQL that gives the same rows."""

from . import diagnostic_queries, io_queries, judge_queries, method_queries, metric_queries, more_queries, protocol_queries, report_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "diagnostic_queries", "io_queries", "judge_queries", "method_queries", "metric_queries", "more_queries", "protocol_queries", "report_queries", "text_queries"]
