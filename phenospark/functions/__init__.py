"""Functions of the screening engine."""
