"""Importing this module registers every query."""
from augury.plans import feature_queries, model_queries, questions, replay_queries, scoring_queries, shape_queries, source_queries  # noqa: F401
from augury.plans.registry import ORACLES, QUERIES  # noqa: F401
