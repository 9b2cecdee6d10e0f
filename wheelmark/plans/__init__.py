"""Plans of the landing engine."""
