"""Scalar functions and aggregates as Column expressions."""
