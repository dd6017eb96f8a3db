"""Dependency-graph analytics on Spark DataFrames.

Every operator takes tables keyed by ``graph_id`` and handles all graphs of a
fleet in one job; no operator assumes that one graph fits one task.
"""
