"""Warehouse activation on Spark: canonical state, exact diffs, ordered delivery."""
