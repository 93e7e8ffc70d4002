"""Scalar functions, as builders of Spark columns."""
