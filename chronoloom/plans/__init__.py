"""Registered queries by family; importing this package fills the registry."""

from chronoloom.plans import dictation_queries, evaluation_queries, grouped_queries, interval_queries, metric_queries, phrase_queries, projection_queries, record_queries, relational_queries, rule_queries, scan_queries, segment_queries, sink_queries, text_queries
from chronoloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "dictation_queries", "evaluation_queries", "grouped_queries", "interval_queries", "metric_queries", "phrase_queries", "projection_queries", "record_queries", "relational_queries", "rule_queries", "scan_queries", "segment_queries", "sink_queries", "text_queries"]
