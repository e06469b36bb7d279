"""Streaming of the screening engine."""
