"""Operators on DataFrames: identity and dedup, roll-ups, status, merge, snapshots, reports."""
