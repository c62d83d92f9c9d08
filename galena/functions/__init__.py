"""Scalar functions: columns in, a column out, all of them built-in expressions."""
