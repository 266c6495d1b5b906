"""Scalar functions, as column expressions wherever Spark has the parts."""
