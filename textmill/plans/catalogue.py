"""Imports every module of queries, so that the registry is full."""

from textmill.plans import agent_queries, check_queries, decision_queries, evaluation_queries, message_queries, model_queries, record_queries, retrieval_queries, table_queries, term_queries, text_queries  # noqa: F401
from textmill.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
