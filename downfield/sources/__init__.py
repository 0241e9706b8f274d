"""Sources of play tables."""
