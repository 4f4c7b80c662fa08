"""Operators for training-data pipelines: one module for each operator.

Nothing outside this folder imports it.  ``queries`` holds the thin registered
queries that derive digest columns from each operator's own outputs.
"""
