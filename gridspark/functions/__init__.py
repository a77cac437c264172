"""Scalar expressions and shared constants."""
