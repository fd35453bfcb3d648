"""Operators of a training-data pipeline; their ready-made queries are in :mod:`tagloom.llm.queries`."""
