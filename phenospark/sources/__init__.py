"""Sources of the screening engine."""
