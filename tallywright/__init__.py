"""Incremental reconciliation of entities and references on Spark DataFrames."""
