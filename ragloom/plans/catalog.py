"""All registered queries over the reference tables, with their oracle SQL."""

from __future__ import annotations

from ragloom.plans import agent_queries, file_queries, function_queries, kg_queries, more_queries, pipeline_queries, prompt_queries, record_queries, retrieval_queries, rule_queries, search_queries, text_queries, trace_queries, training_queries

_PARTS = (kg_queries, text_queries, retrieval_queries, training_queries, pipeline_queries, more_queries, trace_queries, agent_queries, prompt_queries, search_queries, record_queries, file_queries, function_queries, rule_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
