"""Scalar text functions, all of them Spark column expressions."""
