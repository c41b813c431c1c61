"""Scalar and row functions built from Spark expressions."""
