"""All ready-made queries, by group."""

from tagloom.plans import multilabel_queries, run_queries, split_queries, stat_queries, tag_queries, text_queries, vector_queries  # noqa: F401
from tagloom.plans.registry import ORACLES, QUERIES  # noqa: F401
