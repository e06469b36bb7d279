"""Plans of the screening engine."""
