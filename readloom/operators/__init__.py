"""Operators over DataFrames and bytes: joins, scans, and the boundary checkers."""
