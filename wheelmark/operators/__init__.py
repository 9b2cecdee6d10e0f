"""Operators of the landing engine."""
