"""Scalar functions, and parsers that need Python."""
