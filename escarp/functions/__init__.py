"""Scalar and array functions."""
