"""Operators of the screening engine."""
