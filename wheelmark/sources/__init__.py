"""Sources of the landing engine."""
