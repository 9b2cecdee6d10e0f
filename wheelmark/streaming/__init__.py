"""Streaming of the landing engine."""
