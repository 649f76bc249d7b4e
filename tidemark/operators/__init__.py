"""Operators over DataFrames: corpus preparation, scans, lineage, rules, checks, graphs, runs, reports."""
