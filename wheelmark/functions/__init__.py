"""Functions of the landing engine."""
