"""Scalar functions of the data model."""
